"""What a language model judges or writes, as rules that need none.

Each rule is the offline default of one step; a provider's text, parsed by ``functions.text``, can stand in
its place column for column, and what a failed call gives is the stated default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.text import sentences, strip, words

# Words that open a greeting.
GREETINGS = ("hello", "hi", "hey", "good morning", "good evening", "thanks", "thank you", "hallo", "guten tag", "bonjour", "hola", "gracias", "merci", "danke")
COMPLEX_WORDS = 12


def route(question: Column) -> Column:
    """GREETING for a few words that open with one, else VECTOR_SEARCH; null questions are searched."""
    low = strip(F.lower(F.coalesce(question, F.lit(""))))
    opens = low.rlike(r"^(?:" + "|".join(GREETINGS) + r")\b")
    return F.when(opens & (F.size(words(question)) <= 4), "GREETING").otherwise("VECTOR_SEARCH")


def is_complex(question: Column) -> Column:
    """Many words, or two questions in one."""
    w = words(question)
    return F.coalesce((F.size(w) > COMPLEX_WORDS) | F.arrays_overlap(w, F.array(F.lit("and"), F.lit("und"), F.lit("et"), F.lit("y"))), F.lit(False))


def support(claim: Column, context: Column) -> Column:
    """Share of a claim's distinct words that the context has; 0 without either."""
    c = F.array_distinct(words(F.coalesce(claim, F.lit(""))))
    n = F.size(c)
    return F.when(n > 0, F.round(F.size(F.array_intersect(c, words(F.coalesce(context, F.lit(""))))) / n, 4)).otherwise(0.0)


def compress(question: Column, context: Column, least_chars: int = 6000, is_table: Column | None = None) -> Column:
    """Of long contexts without tables the sentences that share a word of over three letters with the question; all if none does."""
    q = F.filter(words(question), lambda w: F.length(w) > 3)
    kept = F.filter(sentences(context), lambda s: F.arrays_overlap(words(s), q))
    long = F.length(context) > least_chars
    if is_table is not None:
        long = long & ~is_table
    return F.when(long & (F.size(kept) > 0), F.array_join(kept, " ")).otherwise(context)


def contradiction(a: Column, b: Column) -> Column:
    """Two texts that agree but for their figures: the same words, other numbers."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"\d+(?:[.,]\d+)?", "#")
    figures = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    return F.coalesce((bare(a) == bare(b)) & (figures(a) != figures(b)), F.lit(False))


def repair(answer: Column, context: Column, least: float = 0.5) -> tuple[Column, Column]:
    """(answer, grounded): sentences too little supported are dropped; an answer that loses all keeps a caveat."""
    each = F.transform(sentences(strip(answer)), lambda s: F.struct(s.alias("s"), support(s, context).alias("v")))
    kept = F.filter(each, lambda x: x["v"] >= least)
    grounded = F.size(kept) == F.size(each)
    text = F.array_join(F.transform(kept, lambda x: x["s"]), " ")
    return F.when(F.size(kept) > 0, text).otherwise("The documents do not support an answer."), grounded


def qa_pairs(text: Column, most: int = 3) -> Column:
    """array(struct(question, answer)): the first sentences that state a figure, each asked for."""
    stated = F.slice(F.filter(sentences(text), lambda s: s.rlike(r"\d") & (F.length(s) > 20)), 1, most)
    return F.transform(stated, lambda s: F.struct(F.concat(F.lit("Which figure is missing: "), F.regexp_replace(s, r"\d+(?:[.,]\d+)?", "…"), F.lit("?")).alias("question"), s.alias("answer")))


def contradictions(rows: DataFrame) -> DataFrame:
    """``id_a, id_b``: rows (``id, parent_id, content``) below one row that agree but for their figures.

    Joined on their words, and copies first made one: only texts with different figures meet, then the ids of each text.
    """
    b = rows.where("parent_id is not null and content is not null").withColumn("bare", F.sha2(F.regexp_replace(F.lower("content"), r"\d+(?:[.,]\d+)?", "#"), 256))
    b = b.withColumn("figures", F.sha2(F.array_join(F.regexp_extract_all("content", F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), " "), 256))
    kinds = b.select("parent_id", "bare", "figures").distinct()
    met = kinds.withColumnRenamed("figures", "fa").join(kinds.withColumnRenamed("figures", "fb"), ["parent_id", "bare"]).where("fa <> fb")
    one = lambda f, i: b.select("parent_id", "bare", F.col("figures").alias(f), F.col("id").alias(i))
    return met.join(one("fa", "id_a"), ["parent_id", "bare", "fa"]).join(one("fb", "id_b"), ["parent_id", "bare", "fb"]).where("id_a < id_b").select("id_a", "id_b")


def reformulate(question: Column) -> Column:
    """The offline second wording of a question: its words of more than three letters, or the question if none is left."""
    kept = F.array_join(F.filter(words(question), lambda w: F.length(w) > 3), " ")
    return F.when(kept != "", kept).otherwise(question)


def sub_questions(question: Column, most: int = 4) -> Column:
    """The offline plan of a complex question: the question itself and the parts that its conjunctions join."""
    parts = F.filter(F.transform(F.split(question, r"(?i)\s+(?:and|und|et|y)\s+|[?;]\s+"), strip), lambda x: F.size(words(x)) > 2)
    return F.when(is_complex(question) & (F.size(parts) > 1), F.slice(F.array_distinct(F.concat(F.array(question), parts)), 1, most)).otherwise(F.array(question))


def rewrite_by_history(question: Column, last: Column) -> Column:
    """The offline rewriting of a question that leans on the one before: a short one that opens with a pronoun or a conjunction gets the last question's words."""
    leans = F.lower(question).rlike(r"^(?:and|but|it|they|he|she|that|this|those|these|und|aber|es|sie|et|mais|il|elle|y|pero)\b") & (F.size(words(question)) <= 8)
    return F.when(leans & F.coalesce(last != "", F.lit(False)), F.concat_ws(" ", last, question)).otherwise(question)
