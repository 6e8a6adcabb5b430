"""Queries of judging and answering, with their SQL where the offline rules have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseam import pipeline, providers
from lodeseam.operators import evaluate, judge
from lodeseam.operators.raptor import build_tree
from lodeseam.plans.text_queries import IX, QA, TRIM, WORDS, _index, _qa
from lodeseam.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with_chunk(spark, d):
    return _qa(spark, d).join(_index(spark, d, "content").withColumnRenamed("id", "chunk_id"), "chunk_id")


BOTH = f"(select q.*, i.content from {QA} q join {IX.format('content')} i on q.chunk_id = i.id)"


@query(f"select id, case when regexp_matches({TRIM.format('lower(question)')}, '^(?:{'|'.join(judge.GREETINGS)})\\b') and len({WORDS.format('question')}) <= 4 then 'GREETING' else 'VECTOR_SEARCH' end route from {QA} where question is not null")
def route_query(spark, d):
    return table(spark, d, "synthetic_qa").where("question is not null").select("id", judge.route(F.col("question")).alias("route")).distinct()


@query(f"select id, len({WORDS.format('question')}) > 12 or len(list_intersect({WORDS.format('question')}, ['and', 'und', 'et', 'y'])) > 0 complex from {QA} where question is not null")
def complex_query(spark, d):
    return table(spark, d, "synthetic_qa").where("question is not null").select("id", judge.is_complex(F.col("question")).alias("complex")).distinct()


def _support(a: str, b: str) -> str:
    return f"case when len({WORDS.format(a)}) > 0 then round(len(list_intersect(list_distinct({WORDS.format(a)}), {WORDS.format(b)})) / len(list_distinct({WORDS.format(a)})), 4) else 0.0 end"


@query(f"select id, {_support(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')', 'content')}::double faithfulness, {_support('question', 'content')}::double context_recall from {BOTH}")
def judge_scores(spark, d):
    return _with_chunk(spark, d).select("id", judge.support(F.col("answer"), F.col("content")).alias("faithfulness"), judge.support(F.col("question"), F.col("content")).alias("context_recall"))


_SENT = r"string_split(regexp_replace({}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))"


@query(
    f"with s as (select *, list_filter({_SENT.format('content')}, lambda s: len(list_intersect(regexp_split_to_array(lower({TRIM.format('s')}), '\\s+'), list_filter({WORDS.format('question')}, lambda w: length(w) > 3))) > 0) k from {BOTH} where question is not null) "
    "select id, sha256(case when length(content) > 300 and len(k) > 0 then array_to_string(k, ' ') else content end) context_hash from s"
)
def compress_context(spark, d):
    both = _with_chunk(spark, d).where("question is not null")
    return both.select("id", F.sha2(judge.compress(F.col("question"), F.col("content"), least_chars=300), 256).alias("context_hash"))


@query(
    f"with s as (select id, content, {_SENT.format(TRIM.format('answer'))} s from {BOTH} where answer is not null), k as (select *, list_filter(s, lambda x: case when len({WORDS.format('x')}) > 0 then len(list_intersect(list_distinct({WORDS.format('x')}), {WORDS.format('content')})) / len(list_distinct({WORDS.format('x')})) else 0 end >= 0.5) k from s) "
    "select id, case when len(k) > 0 then array_to_string(k, ' ') else 'The documents do not support an answer.' end answer, len(k) = len(s) grounded from k"
)
def verify_repair(spark, d):
    answer, grounded = judge.repair(F.col("answer"), F.col("content"))
    return _with_chunk(spark, d).where("answer is not null").select("id", answer.alias("answer"), grounded.alias("grounded"))


_FIGURE = r"\d+(?:[.,]\d+)?"


@query(
    rf"with ix as {IX.format('parent_id, content')}, t as (select * from ix union all select -id - 1, parent_id, regexp_replace(content, '{_FIGURE}', '77', 'g') from ix where id % 20 = 0), "
    rf"b as (select id, parent_id, regexp_replace(lower(content), '{_FIGURE}', '#', 'g') bare, regexp_extract_all(content, '{_FIGURE}') figures from t) "
    "select a.id id_a, b.id id_b from b a join b on a.bare = b.bare and a.parent_id = b.parent_id and a.id < b.id and a.figures <> b.figures"
)
def contradictions(spark, d):
    """Rows below one row that agree but for their figures, among the index and, as it has few, a copy of every twentieth row with all figures changed."""
    ix = _index(spark, d, "parent_id", "content")
    planted = ix.where("id % 20 = 0").select((-F.col("id") - 1).alias("id"), "parent_id", F.regexp_replace("content", _FIGURE, "77").alias("content"))
    return judge.contradictions(ix.unionByName(planted))


@query(
    f"with s as (select id, list_slice(list_filter({_SENT.format('content')}, lambda s: regexp_matches(s, '\\d') and length(s) > 20), 1, 3) s from {IX.format('content, level')} where level = 1) "
    "select id, unnest(s) answer, 'Which figure is missing: ' || regexp_replace(unnest(s), '\\d+(?:[.,]\\d+)?', '…', 'g') || '?' question from s"
)
def synthetic_pairs(spark, d):
    c = _index(spark, d, "content", "level").where("level = 1")
    return c.select("id", F.inline(judge.qa_pairs(F.col("content")))).select("id", "answer", "question")


@query()
def answer_pipeline(spark, d):
    """The stated questions through the whole pipeline."""
    docs = _index(spark, d, F.col("content").alias("text"), "source", "page", "level")
    q = _qa(spark, d).where("id % 100 = 0 and question is not null").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    return pipeline.answer_questions(docs, q)


@query()
def quality_ppi(spark, d):
    """Mean support of the pipeline's answers by the given ones, with its interval."""
    told = answer_pipeline(spark, d).select(F.col("query_id").alias("id"), F.col("answer").alias("told"))
    scored = told.join(_qa(spark, d).select("id", "answer"), "id").select(judge.support(F.col("told"), F.col("answer")).alias("s"))
    return evaluate.interval(scored, "s")


@query()
def raptor_tree(spark, d):
    v = table(spark, d, "doc_index").where("level = 1").select("id", "content").dropDuplicates(["id"])
    return build_tree(v.select("id", "content", providers.embed(F.col("content")).alias("v"))).select("level", "cluster", "n")
