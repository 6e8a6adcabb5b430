"""Questions to answers, all questions at once: sanitise, route, look into the cache, retrieve, grade, answer, check, cite."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.functions import text
from lodeseam.operators import agent, judge
from lodeseam.operators import retrieval as R
from lodeseam.providers import EmbeddingProvider, RerankProvider, embed, rerank_score
from lodeseam.session import cut_lineage
from lodeseam.settings import Settings

GREETING = "Hello! Ask me about the documents."


def searched_rows(docs: DataFrame) -> DataFrame:
    """The rows that a search ranks: all but those of level 0."""
    return docs.where(~F.col("level").eqNullSafe(0))


def search(docs: DataFrame, questions: DataFrame, k: int, degraded: bool = False, embedding: EmbeddingProvider | None = None, stats: tuple | None = None) -> DataFrame:
    """``query_id, id, r``: the fused hits of each question and, if it is complex, of its parts, each once, in the order of its first meeting.

    ``stats``: what :func:`lodeseam.operators.retrieval.bm25_stats` gives of :func:`searched_rows`, if it is known.
    """
    rows = searched_rows(docs)
    parts = questions.select("query_id", F.posexplode(judge.sub_questions(F.col("query"))).alias("query_no", "part"))
    parts = cut_lineage(parts.select(F.xxhash64("query_id", "query_no").alias("part_id"), "query_id", "query_no", "part"))
    asked = parts.select(F.col("part_id").alias("query_id"), F.col("part").alias("query"))
    dense = R.knn(rows.select("id", embed(F.col("text"), embedding).alias("v")), asked.select("query_id", embed(F.col("query"), embedding).alias("v")), k)
    lexical = R.bm25_top(rows.select("id", "text"), asked, 2 * k, stats=stats)
    alpha = asked.select("query_id", text.select_alpha(F.col("query"), judge.is_complex(F.col("query")) | F.lit(degraded)).alias("alpha"))
    fused = R.fuse(dense, lexical, alpha, k).withColumnRenamed("query_id", "part_id").join(parts, "part_id")
    union = R.union_hits(fused.select(F.col("query_id").alias("question_id"), "query_no", "id", "rank", "score"))
    order = [F.col("first_query"), F.col("first_rank"), F.col("id")]
    return R.top_k(union.withColumnRenamed("question_id", "query_id"), "query_id", order, 4 * k, "r").select("query_id", "id", "r")


def retrieve(docs: DataFrame, questions: DataFrame, settings: Settings, degraded: bool = False, embedding: EmbeddingProvider | None = None, rerank: RerankProvider | None = None, k: int | None = None, diverse: bool = True, stats: tuple | None = None) -> DataFrame:
    """``query_id, id, query, text, source, page, ce, place``: the hits of ``questions`` (``query_id, query``) in ``docs`` (``id, text, source, page, level``).

    Without ``diverse`` the last step is left out, and the best reranked ones come in their order.
    """
    _, seven, five = settings.rerank_cascade
    hits = search(docs, questions, k or settings.top_k(degraded), degraded, embedding, stats).join(docs, "id").join(questions, "query_id")
    scored = hits.withColumn("ce", F.round(rerank_score(F.col("query"), F.col("text"), rerank), 6))
    if not diverse:
        return R.top_k(scored, "query_id", [F.desc("ce"), F.col("r")], five, "place").select("query_id", "id", "query", "text", "source", "page", "ce", "place")
    top = R.top_k(scored, "query_id", [F.desc("ce"), F.col("r")], seven)
    vectors = top.select("query_id", "id", "rank", embed(F.col("text"), embedding).alias("v"), embed(F.col("query"), embedding).alias("q"))
    chosen = R.mmr(vectors, five, settings.mmr_weight).withColumnRenamed("place", "rank")
    return R.reorder_for_attention(chosen.join(top.select("query_id", "id", "query", "text", "source", "page", "ce"), ["query_id", "id"]), "ce")


def _told(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, query, context, sources, grade`` of the questions with their hits put together."""
    parts = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "text", "source", "page"))).alias("l"))
    sources = F.array_join(F.array_distinct(F.transform("l", lambda x: text.citation(x["source"], x["page"]))), "\n")
    told = asked.join(parts.select("query_id", F.array_join("l.text", "\n\n---\n\n").alias("context"), sources.alias("sources")), "query_id", "left")
    return told.withColumn("grade", agent.grade(F.col("query"), F.col("context")))


def answer_questions(docs: DataFrame, questions: DataFrame, settings: Settings | None = None, cache: DataFrame | None = None, degraded: bool = False) -> DataFrame:
    """``query_id, key, answer, grade, sources, grounded, cached`` for every question.

    Greetings are answered at once and cached answers (``key, answer``) returned; of the rest the best
    sentence of the hits is the answer, if they are graded relevant. Questions graded AMBIGUOUS are asked once more in
    other words, and the second hits are kept if they are not graded IRRELEVANT; IRRELEVANT ones go to the agent, whose tool
    is the same search without hits graded IRRELEVANT. Questions without any hit get the fixed sentence. ``degraded`` is what :func:`is_degraded` says.
    """
    settings = settings or Settings()
    # read once and counted once for all searches below
    docs = cut_lineage(docs.select("id", "text", "source", "page", "level"))
    stats = R.bm25_stats(searched_rows(docs).select("id", "text"))
    q = questions.select("query_id", text.sanitise_query(F.col("query")).alias("query")).withColumn("route", judge.route(F.col("query"))).withColumn("key", text.cache_key(F.col("query"), F.array().cast("array<string>")))
    known = cache.select("key", F.col("answer").alias("known")) if cache is not None else questions.sparkSession.createDataFrame([], "key string, known string")
    q = cut_lineage(q.join(known, "key", "left"))
    ask = q.where("route = 'VECTOR_SEARCH' and known is null").select("query_id", "query")
    told = cut_lineage(_told(ask, retrieve(docs, ask, settings, degraded, stats=stats)))
    again = told.where("grade = 'AMBIGUOUS'").select("query_id", judge.reformulate(F.col("query")).alias("query"))
    second = cut_lineage(_told(again, retrieve(docs, again, settings, degraded, k=10, diverse=False, stats=stats)).where("grade <> 'IRRELEVANT'"))
    better = second.select("query_id", *[F.col(c).alias(f"{c}2") for c in ("context", "sources", "grade")])
    told = told.join(better, "query_id", "left").select("query_id", "query", *[F.coalesce(f"{c}2", c).alias(c) for c in ("context", "sources", "grade")])
    best = F.array_max(F.transform(text.sentences(F.coalesce("context", F.lit(""))), lambda s: F.struct(judge.support(F.col("query"), s).alias("v"), s.alias("s"))))["s"]
    draft = told.withColumn("draft", F.when(F.col("grade") != "IRRELEVANT", best))
    answer, grounded = judge.repair(F.col("draft"), F.col("context"))

    def tool(asked: DataFrame) -> DataFrame:
        asked = cut_lineage(asked.select("query_id", "query"))
        three = retrieve(docs, asked, settings, degraded, k=10, diverse=False, stats=stats).where("place <= 3").where(agent.grade(F.col("query"), F.col("text")) != "IRRELEVANT").withColumn("s", text.snippet(F.col("source"), F.col("page"), F.col("text")))
        return three.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "s"))).alias("l")).select("query_id", F.array_join("l.s", "\n\n---\n\n").alias("observation"))

    lost = cut_lineage(told.where("grade = 'IRRELEVANT'").select("query_id", "query"))
    agent_said = agent.run_agent(lost, tool, settings.agent_mode).select("query_id", F.when(F.col("answer") != agent.NOTHING_FOUND, F.col("answer")).alias("by_agent")) if not lost.isEmpty() else None
    found = draft.select("query_id", F.when(F.col("draft").isNotNull(), answer).alias("found"), "grade", "sources", F.coalesce(grounded, F.lit(False)).alias("grounded"))
    if agent_said is not None:
        found = found.join(agent_said, "query_id", "left").withColumn("found", F.coalesce("found", "by_agent")).drop("by_agent")
    out = q.join(found.withColumn("found", F.coalesce("found", F.lit(agent.NOTHING_FOUND))), "query_id", "left")
    return out.select("query_id", "key", F.coalesce("known", F.when(F.col("route") == "GREETING", GREETING), "found").alias("answer"), "grade", "sources", F.coalesce("grounded", F.lit(True)).alias("grounded"), F.col("known").isNotNull().alias("cached"))


def remember(cache: DataFrame | None, answers: DataFrame) -> DataFrame:
    """The answer cache (``key, answer``) with the grounded new answers of :func:`answer_questions`; of one key the first counts."""
    new = answers.where("not cached and grounded and grade <> 'IRRELEVANT'").groupBy("key").agg(F.min_by("answer", "query_id").alias("answer"))
    return new if cache is None else cache.select("key", "answer").unionByName(new.join(cache.select("key"), "key", "left_anti"))


def is_degraded(scores: DataFrame) -> bool:
    """Whether the gate over the stored scores (``overall``, in the order of ``evaluated_at, id``) is shut at the end."""
    from lodeseam.operators.evaluate import quality_gate

    last = quality_gate(scores.where("overall is not null"), "overall", [F.col("evaluated_at"), F.col("id")]).orderBy(F.desc("pos")).select("degraded").first()
    return bool(last and last["degraded"])


def stream_answer(docs: DataFrame, question: str, settings: Settings | None = None) -> Iterator[str]:
    """One question's answer word by word, as a console shows it."""
    asked = docs.sparkSession.createDataFrame([(0, question)], "query_id bigint, query string")
    yield "Searching...\n"
    row = answer_questions(docs, asked, settings).first()
    for word in (row["answer"] or agent.NOTHING_FOUND).split(" "):
        yield word + " "
    if row["sources"]:
        yield "\n" + row["sources"]
