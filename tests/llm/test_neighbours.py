import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam.llm import neighbours


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v], "c", 1.0) for i, v in zip(ids, x)], "id bigint, v array<float>, neighbour string, cosine double")


def exact(x, ids, k):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[ids[i]] = [b for _, b in order]
    return out


def result(df):
    got = {}
    for r in df.orderBy("id", F.desc("cosine"), "neighbour").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    return got


def test_search_that_may_miss_nothing_is_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x[10:30] = x[3]  # a third of the rows are copies
    x[40] = x[41]
    ids = rng.permutation(1000)[:60].tolist()
    got = neighbours.nearest(frame(spark, x, ids), "id", "v", dim=8, k=5, miss=0.0)
    assert got.columns == ["id", "neighbour", "cosine"] and result(got) == exact(x, ids, 5)


@pytest.mark.parametrize("block", [8192, 40])
def test_near_pairs_are_found_over_many_cells(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)  # 40: every cell is indexed in parts
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 64))
    near = base[:300] + 0.25 * rng.standard_normal((300, 64))
    x = np.concatenate([base, near])
    got = neighbours.nearest(frame(spark, x), "id", "v", least=0.9)
    pairs = {tuple(sorted((r["id"], r["neighbour"]))) for r in got.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(u @ u.T, 1)
    want = set(map(tuple, np.argwhere(s >= 0.9)))
    assert pairs <= want and len(pairs) >= 0.97 * len(want)


def test_deep_trees_lose_no_more_near_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 12)  # 256 cells a tree, as for more than a million rows
    monkeypatch.setattr(neighbours, "DENSE_LEVELS", 4, raising=False)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((800, 64))
    off -= (off * base[:800]).sum(axis=1, keepdims=True) * base[:800]
    near = 0.905 * base[:800] + np.sqrt(1 - 0.905**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    got = neighbours.nearest(frame(spark, np.concatenate([base, near])), "id", "v", least=0.9)
    pairs = {tuple(sorted((r["id"], r["neighbour"]))) for r in got.collect()}
    assert pairs <= {(i, 2000 + i) for i in range(800)} and len(pairs) >= 0.98 * 800


def test_wide_search_reaches_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    x = np.random.default_rng(3).standard_normal((2000, 64))
    want = exact(x, list(range(2000)), 5)
    got = result(neighbours.nearest(frame(spark, x), "id", "v", miss=0.1, asks=F.col("id") % 50 == 0))
    assert got.keys() == set(range(0, 2000, 50))
    assert sum(len(set(got[i]) & set(want[i])) for i in got) >= 0.9 * 5 * len(got)


def test_usable_and_empty(spark):
    rows = [(1, [1.0, 0.0], True), (2, [0.0, 0.0], True), (3, [float("nan"), 1.0], True), (4, [1.0], True), (5, None, True), (6, [1.0, 1.0], False), (7, [float("inf"), 0.0], True), (8, [None, 1.0], True), (9, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>, ok boolean")
    kept = neighbours.usable(df, "v", 2, "ok")
    assert [r["id"] for r in kept.collect()] == [1]
    assert neighbours.nearest(kept, "id", "v", dim=2).count() == 0
    assert neighbours.nearest(kept.limit(0), "id", "v", dim=2).count() == 0
