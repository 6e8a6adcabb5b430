"""Rankings against brute force in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam import providers
from lodeseam.operators import agent, conversation, evaluate, maintenance
from lodeseam.operators import retrieval as R


def test_bm25(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta the the the".split()) for _ in range(rng.randrange(0, 20)))) for i in range(60)]
    queries = [(1, "alpha the the"), (2, "unknown"), (3, "eps zeta"), (4, "")]
    n, toks = len(docs), {i: t.split() for i, t in docs}
    avg = sum(map(len, toks.values())) / n
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if r < 0 else r for w, r in raw.items()}
    want = {}
    for q, text in queries:
        for i, t in toks.items():
            tf = Counter(t)
            hit = [w for w in text.split() if tf[w]]
            if hit:
                want[q, i] = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in hit)
    got = R.bm25_scores(spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, query string"))
    got = {(r["query_id"], r["id"]): r["score"] for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


@pytest.mark.parametrize("limit", [20_000, 4])
def test_knn_and_ivf(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "DOC_BLOCK", 50)
    monkeypatch.setattr(R, "QUERY_LIMIT", limit)  # 4: queries and documents meet in blocks
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8))
    x[5] = x[9]
    x[7] = 0
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    q = docs.where("id % 20 = 9").withColumnRenamed("id", "query_id")
    got = {}
    for r in R.knn(docs, q, 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    u = x / np.maximum(1e-300, np.linalg.norm(x, axis=1))[:, None]
    for i in range(9, 200, 20):
        d = np.round(1 - u @ u[i], 6) + 0.0
        d[7] = np.inf
        assert [got[i][k] for k in (1, 2, 3, 4)] == list(np.lexsort((np.arange(200), d))[:4])
    index, centres = R.ivf_index(docs.where("id <> 7"), 4)
    full = R.ivf_search(index, centres, q, 4, probes=4)
    assert full.select("query_id", "id").exceptAll(R.knn(docs.where("id <> 7"), q, 4).select("query_id", "id")).count() == 0
    assert R.knn(docs, q.limit(0), 4).count() == 0


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id bigint, id bigint, rank int")
    lexical = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (3, 12, 1)], "query_id bigint, id bigint, rank int")
    alpha = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "query_id bigint, alpha double")
    got = [(r["query_id"], r["id"]) for r in R.fuse(dense, lexical, alpha, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11), (1, 10), (2, 10), (3, 12)]
    assert {r["query_id"] for r in R.fuse(dense, lexical, alpha, 2, need_dense=True).collect()} == {1, 2}


def test_propositions_expand(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, 1, 0), (3, 1, 0), (4, 99, 0), (5, None, 0), (6, None, None)], "id bigint, parent_id bigint, level int")
    hits = spark.createDataFrame([(7, 2, 1), (7, 3, 2), (7, 1, 3), (7, 4, 4), (7, 5, 5), (7, 6, 6)], "query_id bigint, id bigint, rank int")
    assert [r["shown_id"] for r in R.expand_propositions(hits, docs).orderBy("rank").collect()] == [1, 4, 6]


def test_mmr(spark):
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((12, 5)), rng.standard_normal(5)
    x[3] = x[1]
    u, w = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q)
    chosen = []
    for _ in range(5):
        score = {i: 0.7 * u[i] @ w - 0.3 * max(u[i] @ u[j] for j in chosen) if chosen else u[i] @ w for i in range(12) if i not in chosen}
        chosen.append(max(score, key=lambda i: (score[i], -i)))
    df = spark.createDataFrame([(1, i, i, v.tolist(), q.tolist()) for i, v in enumerate(x)] + [(2, 1, 1, x[0].tolist(), q.tolist())], "query_id bigint, id bigint, rank int, v array<double>, q array<double>")
    got = R.mmr(df, 5, 0.7).orderBy("query_id", "place").collect()
    assert [r["id"] for r in got if r["query_id"] == 1] == chosen and [r["id"] for r in got if r["query_id"] == 2] == [1]


def test_reorder_and_max_sim(spark):
    h = spark.createDataFrame([(n, i, i, 1.0 / i) for n in (1, 2, 3, 5) for i in range(1, n + 1)], "query_id bigint, id bigint, rank int, s double")
    got = {n: [r["id"] for r in R.reorder_for_attention(h, "s").where(f"query_id = {n}").orderBy("place").collect()] for n in (1, 2, 3, 5)}
    assert got == {1: [1], 2: [1, 2], 3: [1, 3, 2], 5: [1, 3, 4, 5, 2]}
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[1.0, 1.0], [3.0, -1.0]])], "q array<array<double>>, d array<array<double>>")
    assert df.select(R.max_sim(F.col("q"), F.col("d"))).first()[0] == 2.5


def test_union_last_value_wins(spark):
    h = spark.createDataFrame([(1, 1, 0, 1, 0.5), (1, 1, 4, 2, 0.4), (1, 2, 0, 3, 0.9), (1, 2, None, 1, 1.0)], "question_id bigint, query_no int, id bigint, rank int, score double")
    assert sorted(tuple(r) for r in R.union_hits(h).collect()) == [(1, 0, 1, 1, 0.9), (1, 4, 1, 2, 0.4)]


def test_gate_blocks_agree_with_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 16)
    rng = random.Random(4)
    level = [0.9] * 30 + [0.2] * 25 + [0.62] * 30 + [0.95] * 40
    rows = [(i, round(v + rng.uniform(-0.05, 0.05), 3)) for i, v in enumerate(level)]
    want, last, state = [], [], False
    for i, v in rows:
        last = [*last, v][-10:]
        m = sum(last) / len(last)
        state = True if round(m, 6) < 0.5 else False if round(m, 6) > 0.7 else state
        want.append((i, state))
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "id bigint, f double")
    got = evaluate.quality_gate(df, "f", [F.asc("id")]).orderBy("id").collect()
    assert [(r["id"], r["degraded"]) for r in got] == want and [r["pos"] for r in got] == list(range(len(rows)))


def test_bootstrap(spark):
    low, high = evaluate.bca_interval(np.linspace(0, 1, 40))
    assert 0.35 < low < 0.5 < high < 0.65
    assert evaluate.bca_interval(np.ones(5)) == (1.0, 1.0)


def test_file_states_and_registry(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "filename string, file_hash string")
    reg = spark.createDataFrame([("b", "2", "m"), ("c", "x", "m"), ("d", "4", "old"), ("e", "5", "m")], "filename string, file_hash string, embed_model string")
    assert {tuple(r) for r in maintenance.file_states(found, reg, "m").collect()} == {("a", "new"), ("b", "unchanged"), ("c", "content_changed"), ("d", "model_changed"), ("e", "deleted")}
    assert {tuple(r) for r in maintenance.upsert_registry(reg, found.where("filename in ('a', 'c')"), "n").collect()} == {("a", "1", "n"), ("b", "2", "m"), ("c", "3", "n"), ("d", "4", "old"), ("e", "5", "m")}


def test_conversations(spark):
    m = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "A"), (1, 3, "system", "T")], "conv_id bigint, turn bigint, role string, content string")
    got = [(r["turn"], r["role"], r["content"]) for r in conversation.fold_system(m).orderBy("turn").collect()]
    assert got == [(1, "user", "[SYSTEM INSTRUCTIONS]\nS\n[END SYSTEM INSTRUCTIONS]\n\nQ"), (2, "model", "A"), (3, "user", "[SYSTEM INSTRUCTIONS]\nT\n[END SYSTEM INSTRUCTIONS]")]
    assert conversation.tail(m, 2).count() == 2


def test_agents(spark):
    q = spark.createDataFrame([(1, "where is it"), (2, "nowhere")], "query_id bigint, query string")
    search = lambda asked: asked.select("query_id", F.when(F.col("query_id") == 1, F.lit("it is in the long grey cabinet")).alias("observation"))
    got = {r["query_id"]: (r["answer"], len(r["steps"])) for r in agent.run_react(q, search).collect()}
    assert got == {1: ("it is in the long grey cabinet", 1), 2: ("No documents found.", 1)}
    plans = spark.createDataFrame([(1, ["please calculate 2+3"]), (2, ["find it"])], "question_id bigint, steps array<string>")
    found = lambda asked: asked.select("query_id", F.lit("a long enough observation of the thing").alias("observation"))
    assert {r["question_id"]: r["answer"] for r in agent.plan_execute(plans, found).collect()} == {1: "5", 2: "a long enough observation of the thing"}


def test_failing_provider_masks(spark):
    class Broken(providers.EmbeddingProvider):
        def embed(self, texts):
            raise RuntimeError("down")

    df = spark.createDataFrame([("x", "text"), ("y", "image")], "t string, m string").withColumn("v", providers.embed(F.col("t"), Broken()))
    v, ok = providers.mask_failures(F.col("v"), F.col("m"))
    assert [(len(r[0]), r[1]) for r in df.select(v, ok).collect()] == [(64, False), (64, False)]
