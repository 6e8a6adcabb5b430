"""Rankings that are made in the documents' tasks."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lodeseam.functions.text import words
from lodeseam.operators import retrieval as R
from lodeseam.plans import retrieval_queries as Q
from lodeseam.providers import EmbeddingProvider, _Slots


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, n, n_queries, seed, ids=lambda i: i):
    rng = random.Random(seed)
    some = lambda most: " ".join(f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randrange(0, most)))
    return spark.createDataFrame([(ids(i), some(30)) for i in range(n)], "id bigint, text string"), spark.createDataFrame([(i, some(9)) for i in range(n_queries)], "query_id bigint, query string")


def test_bm25_top_never_shuffles_pairs(spark, monkeypatch):
    for block in (2048, 7):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        monkeypatch.setattr(R, "DOC_BLOCK", 5 * block)
        # every second id of the last is met twice
        for ids in (lambda i: i, lambda i: i // 2 if i % 4 < 2 else i):
            docs, queries = texts(spark, 400, 40, block, ids)
            want = R.top_k(R.bm25_scores(docs, queries).where("score > 0"), "query_id", [F.desc("score"), F.col("id")], 5)
            got = R.bm25_top(docs, queries, 5)
            assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(*got.columns).collect()} and got.count()
    docs, queries = texts(spark, 50, 5, 3)
    assert "Join" not in plan_of(R.bm25_top(docs, queries, 5)) and R.bm25_top(docs, queries.limit(0), 5).count() == 0


def test_knn_many_queries_copies_no_document(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_LIMIT", 10)
    monkeypatch.setattr(R, "DOC_BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 6))
    x[3], x[4], x[10:20] = 0, x[5] * 1e150, x[20]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    asked = docs.where("id % 7 < 2").withColumnRenamed("id", "query_id")
    for metric in ("cosine", "l2"):
        got = R.knn(docs, asked, 6, metric=metric)
        assert "FlatMapCoGroups" not in plan_of(got)
        at = {}
        for r in got.collect():
            at.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
        for i in (i for i in range(300) if i % 7 < 2):
            d = R._distances(x[i : i + 1], x, metric, 6)[0]
            near = [j for j in np.lexsort((np.arange(300), d))[:6] if np.isfinite(d[j])]
            assert [at.get(i, {}).get(k + 1) for k in range(len(near))] == near, (metric, i)


def test_inverted_file_meets_in_its_tasks(spark):
    x = np.random.default_rng(5).standard_normal((200, 8))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    index, centres = R.ivf_index(docs, 4)
    asked = docs.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    found = R.ivf_search(index, centres, asked, 3, probes=2)
    assert "Join" not in plan_of(found)
    cell = {r["id"]: r["cell"] for r in index.collect()}
    at = {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}
    for i in range(0, 200, 9):
        looked = set(np.argsort(((centres - x[i]) ** 2).sum(axis=1))[:2])
        mine = np.array([j for j in range(200) if cell[j] in looked])
        d = R._distances(x[i : i + 1], x[mine], "cosine", 6)[0]
        assert [at[i, k] for k in (1, 2, 3)] == list(mine[np.lexsort((mine, d))[:3]])


@pytest.mark.parametrize("name", ["agent_chain", "attention_reorder", "cross_rerank", "legacy_mmr", "legacy_sources", "linear_hybrid", "mmr_select", "multi_query_union", "parent_expand", "source_citations", "ircot_trajectory", "quality_ppi"])
def test_search_joins_no_postings(spark, monkeypatch, name):
    """Every query that searches ranks documents in their own tasks; pairs of postings are for ids met more than once alone."""

    def pairs(*args):
        raise AssertionError("postings are joined with queries")

    monkeypatch.setattr(R, "_bm25_sum", pairs)
    assert queries()[name](spark, "/root/testdata/sf0.001").count()


def test_embedding_counts_words_of_a_whole_batch():
    def one(t):
        v = np.zeros(64)
        for w in (t or "").lower().split():
            h = hashlib.sha256(w.encode()).hexdigest()
            v[int(h[:8], 16) % 64] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
        n = math.sqrt(v @ v)
        return v / n if n else v

    said = [None, "", "  \n", "a b a", "İx ß ÄÖ", "one " * 70, *(f"w{i} w{i % 7} x" for i in range(300))]
    provider = EmbeddingProvider()
    assert (np.stack(provider.embed(said)) == np.stack([one(t) for t in said])).all() and provider.embed([]) == []
    slots = _Slots()
    slots.most = 3  # words forgotten and met again have the same slot
    assert [slots[w] for w in "abcdabcd"] == [_Slots()[w] for w in "abcdabcd"] and len(slots) <= 3


def test_words_need_no_stripping(spark):
    said = ["", "  ", " Ab  c \n", "x", None, "a b c"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(words(F.col("s"))).collect()]
    assert got == [None if s is None else s.lower().split() for s in said]


def test_union_of_searches_reads_the_documents_once(spark, monkeypatch):
    asked, hybrid = [], Q._hybrid
    monkeypatch.setattr(Q, "_hybrid", lambda *a, **k: asked.append(1) or hybrid(*a, **k))
    got = Q.multi_query_union(spark, "/root/testdata/sf0.001")
    assert len(asked) == 1 and {r[0] for r in got.select("first_query").distinct().collect()} == {1, 2}


def test_answers_count_the_words_of_the_documents_once(spark, monkeypatch):
    counted, stats = [], R.bm25_stats
    monkeypatch.setattr(R, "bm25_stats", lambda docs: counted.append(1) or stats(docs))
    assert queries()["answer_pipeline"](spark, "/root/testdata/sf0.001").count() and len(counted) == 1
