"""The pipeline from question to answer, and the rules it judges by."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam import index, pipeline, schema
from lodeseam.functions import text
from lodeseam.operators import agent, evaluate, judge
from lodeseam.operators.cluster import cluster_vectors
from lodeseam.operators.raptor import build_tree
from lodeseam.providers import embed
from lodeseam.settings import Settings

DOCS = [(i, t, f"data/file{i}.txt", i or None, 0 if i == 5 else 1) for i, t in enumerate(["The harbour pump holds 40 bar. It is checked in spring.", "The keeper writes every figure into the ledger.", "Apples grow on trees in the orchard.", "The pump in the orchard holds 12 bar.", "Nothing to see in this text at all.", "The harbour pump holds 40 bar."])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id bigint, text string, source string, page int, level int")


def test_answers(spark, docs):
    q = spark.createDataFrame([(1, "what does the harbour pump hold"), (2, "hello there"), (3, "zzz qqq xxx"), (4, "cached one please now")], "query_id bigint, query string")
    known = spark.createDataFrame([("cached one please now", "from the cache")], "q string, answer string").select(text.cache_key(F.col("q"), F.array().cast("array<string>")).alias("key"), "answer")
    got = {r["query_id"]: r for r in pipeline.answer_questions(docs, q, cache=known).collect()}
    assert "harbour pump holds 40 bar" in got[1]["answer"] and "• file0.txt" in got[1]["sources"] and got[1]["grounded"]
    assert got[2]["answer"] == pipeline.GREETING and got[4]["answer"] == "from the cache" and got[4]["cached"]
    assert got[3]["grade"] == "IRRELEVANT" and got[3]["answer"].startswith("No relevant information")
    assert len("".join(pipeline.stream_answer(docs, "what does the harbour pump hold"))) > 20


def test_rules(spark):
    df = spark.createDataFrame([("It holds 40 bar. The moon is made of cheese.", "It holds 40 bar when open", "It holds 41 bar. The moon is made of cheese.")], "a string, c string, b string")
    answer, grounded = judge.repair(F.col("a"), F.col("c"))
    r = df.select(answer.alias("x"), grounded.alias("g"), judge.contradiction(F.col("a"), F.col("b")).alias("k"), judge.contradiction(F.col("a"), F.col("c")).alias("n")).first()
    assert (r["x"], r["g"], r["k"], r["n"]) == ("It holds 40 bar.", False, True, False)
    assert df.select(judge.support(F.lit(None).cast("string"), F.col("c"))).first()[0] == 0.0


def test_tree_and_settings(spark):
    df = spark.createDataFrame([(i, f"{'pump harbour bar' if i % 2 else 'tree apple orchard'} number {i}") for i in range(40)], "id bigint, content string")
    tree = build_tree(df.select("id", "content", embed(F.col("content")).alias("v")))
    assert tree.where("level = 2").agg(F.sum("n")).first()[0] <= 40 and tree.where("level = 2").count() >= 2
    assert Settings().top_k(True) == 25 and Settings().embed_signature == "hashing_minnow-64_unpin"
    with pytest.raises(ValueError):
        Settings(agent_mode="other")


@pytest.mark.parametrize("k", [4, 11])
def test_every_number_of_clusters_is_tried(spark, k):
    rng = np.random.default_rng(k)
    centre = 3 * rng.standard_normal((k, 12))
    x = np.repeat(centre, 150, axis=0) + 0.2 * rng.standard_normal((150 * k, 12))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = {r["id"]: r["cluster"] for r in cluster_vectors(df).collect()}
    assert len(got) == 150 * k and len({(i // 150, c) for i, c in got.items()}) == k == len(set(got.values()))


def test_tree_goes_on_above_few_summaries(spark):
    words = ["pump harbour bar", "tree apple orchard", "ledger figure keeper", "violin concert hall", "glacier ridge snow"]
    df = spark.createDataFrame([(i, f"{words[i % 5]} number {i}") for i in range(150)], "id bigint, content string")
    tree = build_tree(df.select("id", "content", embed(F.col("content")).alias("v")))
    n = {r["level"]: r["n"] for r in tree.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert 3 <= n[2] <= 10 and n[3] >= 1 and set(n) == {2, 3}


def test_tables(spark, tmp_path):
    spark.sql(f"create database if not exists made location '{tmp_path}'")
    schema.create_tables(spark, "made")
    assert {r["tableName"] for r in spark.sql("show tables in made").collect()} == set(schema.TABLES)
    assert spark.table("made.documents").columns[:3] == ["id", "doc_hash", "doc_type"]
    schema.drop_tables(spark, "made")
    assert spark.sql("show tables in made").count() == 0


def test_complex_questions_go_through_the_loop_and_others_by_plan(spark):
    facts = {"pump": "The harbour pump holds 40 bar and is sealed by the keeper every spring.", "the harbour pump holds": "The keeper is named Orla."}
    rows = spark.createDataFrame([(k, v) for k, v in facts.items()], "k string, observation string")

    def search(asked):
        hit = asked.join(rows, F.lower("query").contains(F.col("k")), "left")
        return hit.groupBy("query_id").agg(F.max("observation").alias("observation"))

    asked = spark.createDataFrame([(1, "Which pressure holds the pump and who seals it?"), (2, "pump"), (3, "nothing known and nothing found")], "query_id bigint, query string")
    got = {r["query_id"]: (r["way"], r["answer"]) for r in agent.run_agent(asked, search, provider=agent.ScriptedReasoner(hops=2)).collect()}
    # the second hop asks for what the first observation begins with, and both are in the answer
    assert got[1][0] == "react" and "40 bar" in got[1][1] and got[1][1].count("\n") == 1
    assert got[2] == ("plan", facts["pump"]) and got[3] == ("plan", agent.NOTHING_FOUND)
    assert agent.run_agent(asked.limit(0), search).count() == 0


def test_answers_are_remembered_and_asked_again_in_other_words(spark):
    docs = spark.createDataFrame(
        [(1, "The harbour pump holds 40 bar since the last audit.", "a.txt", 1, 1), (2, "The ledger is kept by the keeper.", "b.txt", None, 1)], "id bigint, text string, source string, page int, level int"
    )
    asked = spark.createDataFrame([(1, "what does the harbour pump hold since the audit"), (2, "hello"), (3, "zzz qqq")], "query_id bigint, query string")
    first = pipeline.answer_questions(docs, asked)
    cache = pipeline.remember(None, first)
    assert cache.count() == 1 and pipeline.remember(cache, first).count() == 1
    again = {r["query_id"]: r for r in pipeline.answer_questions(docs, asked, cache=cache).collect()}
    assert again[1]["cached"] and "40 bar" in again[1]["answer"] and not again[3]["cached"]
    parts = spark.createDataFrame([("who keeps the ledger and what holds the pump?",), ("short",)], "q string").select(judge.sub_questions(F.col("q")).alias("p"), judge.reformulate(F.col("q")).alias("r")).collect()
    assert parts[0]["p"][1:] == ["who keeps the ledger", "what holds the pump?"] and parts[1]["p"] == ["short"] and parts[0]["r"] == "keeps ledger what holds pump?"
    told = spark.createDataFrame([("and how old is it?", "which pump is sealed"), ("and how old is it?", None)], "q string, last string").select(judge.rewrite_by_history(F.col("q"), F.col("last")).alias("r")).collect()
    assert [r["r"] for r in told] == ["which pump is sealed and how old is it?", "and how old is it?"]


def test_the_gate_over_stored_scores_widens_the_search(spark, tmp_path):
    store = str(tmp_path)
    make = lambda v, at: spark.createDataFrame([(i + 100 * at, "q", v, v, v, v) for i in range(12)], "id bigint, query string, faithfulness double, answer_relevance double, context_recall double, overall double").selectExpr("*", f"timestamp_ntz'2024-01-0{at} 00:00:00' as evaluated_at")
    index.append_table(make(0.9, 1), store, "eval_results")
    assert not pipeline.is_degraded(index.read_table(spark, store, "eval_results"))
    index.append_table(make(0.1, 2), store, "eval_results")
    scores = index.read_table(spark, store, "eval_results")
    assert scores.count() == 24 and pipeline.is_degraded(scores) and not pipeline.is_degraded(scores.limit(0))


def test_an_interval_of_all_rows(spark):
    got = evaluate.interval(spark.range(20_000).selectExpr("id / 20000D as v"), "v").first()
    assert got["n"] == 20_000 and abs(got["mean"] - 0.5) < 1e-3 and 0.490 < got["low"] < got["mean"] < got["high"] < 0.510
    same = evaluate.interval(spark.range(5).selectExpr("1.0D as v"), "v").first()
    assert (same["low"], same["high"], same["n"]) == (1.0, 1.0, 5)
    assert evaluate.interval(spark.range(0).selectExpr("1.0D as v"), "v").first()["n"] == 0
