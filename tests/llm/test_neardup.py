import random
import re

import numpy as np
import pytest

from lodeseam.llm import graph, neardup


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(vocab) for _ in range(rng.randrange(40, 120))] for _ in range(n)]
    for k in range(n):
        t = list(rng.choice(texts[:n]))
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(t)
    return [" ".join(t) for t in texts] + [" ".join(texts[0]).upper(), " - ".join(texts[0])]


def sets(t, width):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def pairs(texts, threshold, width):
    s = [sets(t, width) for t in texts]
    return {(a, b) for a in range(len(s)) for b in range(a + 1, len(s)) if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def test_masks_cover_every_set_of_places():
    from itertools import combinations

    for places in combinations(range(neardup.D), neardup.R):
        assert any(not set(kept) & set(places) for kept in neardup.MASKS)
    assert all(len(kept) for kept in neardup.MASKS)


@pytest.mark.parametrize("hot", [False, True])
def test_like_brute_force(spark, hot, monkeypatch):
    if hot:  # keys that many texts share are looked through in pairs of blocks
        monkeypatch.setattr(neardup, "BLOCK", 3)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "id bigint, t string, rep string, d int")
    members, links = neardup.near_duplicates(df, "id", "t", 0.6, 3)
    got = neardup.all_pairs(members, links).collect()
    assert len(got) == len(set(got))
    want = pairs(texts, 0.6, 3)
    # candidates may miss a pair at the very threshold, never add one
    assert {tuple(r) for r in got} <= want and len(got) >= 0.99 * len(want)
    groups = {r["id"]: (r["group_id"], r["n_links"]) for r in neardup.duplicate_groups(members, links).collect()}
    assert len(groups) == len(texts)
    for a, b in map(tuple, got):
        assert groups[a][0] == groups[b][0]


def test_a_key_shared_by_many_unlike_texts_sends_no_pairs_on(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rng = np.random.default_rng(6)
    symbols = rng.integers(0, 1 << 32, (400, neardup.SYMBOLS), dtype=np.uint64).astype("<u4")
    symbols[:, : neardup.D] = 7  # all agree on one part, and only two on more
    symbols[9] = symbols[8]
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(symbols)]
    got = neardup.candidates(spark.createDataFrame(rows, "id bigint, symbols binary"), 400, 0.6)
    assert [tuple(r) for r in got.collect()] == [(8, 9)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "too short"), (None, "a b c d e f g"), (5, "a b c d e f g"), (6, "A, b. c d E f g!"), (7, "x " * 200_000), (8, "… — !")]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "id bigint, t string"), "id", "t")
    assert {(r["id"], r["rep"]) for r in members.collect()} == {(5, 5), (6, 5), (7, 7)} and links.count() == 0
    assert {(r["id"], r["group_id"], r["n_links"]) for r in neardup.duplicate_groups(members, links).collect()} == {(5, 5, 0), (6, 5, 0), (7, 7, 0)}
    none = spark.createDataFrame([], "id bigint, t string")
    members, links = neardup.near_duplicates(none, "id", "t")
    assert members.count() == 0 and neardup.duplicate_groups(members, links).count() == 0 and neardup.all_pairs(members, links).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        return x if up[x] == x else find(up[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in up}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
