import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam.llm import mix, pack, tokens


def test_sum_of_squares_is_valid_and_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 3000)
    box = pack.sum_of_squares(sizes, 100)
    fill = np.bincount(box, weights=sizes)
    assert fill.max() <= 100 and fill.min() > 0 and len(fill) <= 1.05 * sizes.sum() / 100
    assert len(set(pack.sum_of_squares(np.array([100, 60, 40, 30, 70]), 100))) == 3


def test_every_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = rng.integers(1, 10, 60)
        box, levels, level_of = pack.sum_of_squares(sizes, 10, merge=False), np.zeros(11, dtype=int), {}
        for b, s in zip(box.tolist(), sizes.tolist()):
            def after(h):
                n = levels.copy()
                n[h] -= h > 0
                n[h + s] += h + s < 10
                return (n**2).sum()

            ways = {h: after(h) for h in range(11 - s) if h == 0 or levels[h]}
            h = level_of.get(b, 0)
            assert after(h) == min(ways.values())
            levels[h] -= h > 0
            levels[h + s] += h + s < 10
            level_of[b] = h + s


@pytest.mark.parametrize("shard", [200_000, 50])
def test_pack_splits_only_the_oversized(spark, monkeypatch, shard):
    monkeypatch.setattr(pack, "SHARD_ITEMS", shard)
    rng = random.Random(2)
    sizes = [None, 0, 10, 11, 20, 25, 305] + [rng.randrange(1, 40) for _ in range(300)]
    df = spark.createDataFrame([(i, s, "c") for i, s in enumerate(sizes)] + [(3, 11, "c")], "id bigint, s int, container string")
    rows = pack.pack(df, "id", F.col("s"), 10).collect()
    by, fill = Counter(), Counter()
    for r in rows:
        by[r["id"]] += r["n_tokens"]
        assert (r["container"] is None) == (r["n_tokens"] == 0)
        if r["container"]:
            fill[r["container"]] += r["n_tokens"]
    assert by == Counter({i: s or 0 for i, s in enumerate(sizes) if i != 3} | {3: 22}) and max(fill.values()) <= 10
    assert {r["id"] for r in rows if r["piece_no"] > 0} == {i for i, s in enumerate(sizes) if s and s > 10}
    assert pack.pack(df.limit(0), "id", F.col("s"), 10).count() == 0


def test_tokens_and_cut(spark):
    t = "Grüße 漢字 and <|endoftext|> " * 50
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "x" * 300_000)], "id bigint, t string")
    n = {r["id"]: r["n"] for r in df.select("id", tokens.token_count(F.col("t")).alias("n")).collect()}
    assert n[2] == n[3] == 0 and n[1] > 200 and n[4] > 1000
    pieces = pack.pack_documents(df.where("id = 1"), "id", "t", 64).join(df.where("id = 1"), "id")
    cut = pieces.withColumn("cut", pack.cut_tokens(pieces, "t", "piece_no", 64)).orderBy("piece_no").collect()
    # a character divided between two pieces shows as its bytes, in hexadecimal
    whole = "".join(r["cut"] for r in cut).encode().decode("unicode_escape", errors="ignore").encode("latin-1", errors="ignore") if any("\\x" in r["cut"] for r in cut) else None
    assert whole is not None or "".join(r["cut"] for r in cut) == t


def mixed(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "key bigint, source string, size int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    selected, wanted = mix.plan_mixture(d, t, **kw)
    return {r["key"]: r["copies"] for r in selected.collect()}, {r["source"]: r for r in mix.mixture_shares(selected, wanted).collect()}


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice("aaabc"), rng.randrange(1, 50)) for i in range(4000)] + [(9000 + i, "tiny", 10) for i in range(5)] + [(9100, None, 10), (9101, "other", 10), (9102, "a", 0)]
    have = Counter()
    for _, s, n in docs:
        have[s] += n
    budget = have["a"] + have["b"] + have["tiny"]
    copies, shares = mixed(spark, docs, [("a", 0.2, 3), ("b", 0.5, 8), ("tiny", 0.29, 2), ("gone", 0.01, 4)], budget=budget)
    for s, share in (("a", 0.2), ("b", 0.5)):
        assert abs(shares[s]["reached"] - share * budget) <= 50 and not shares[s]["short"]
    assert shares["tiny"]["reached"] == 100 and shares["tiny"]["short"] and shares["gone"]["reached"] == 0 and shares["gone"]["short"]
    b = [c for k, c in copies.items() if k < 4000 and docs[k][1] == "b"]
    assert max(b) - min(b) <= 1 and max(b) <= 8 and {copies[9000 + i] for i in range(5)} == {2}
    assert not {9100, 9101} & copies.keys() and all(docs[k][1] != "c" for k in copies if k < 4000)
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    # copies within a round follow the hash only, so the mixture is the same again
    assert mixed(spark, docs, [("a", 0.2, 3), ("b", 0.5, 8), ("tiny", 0.29, 2), ("gone", 0.01, 4)], budget=budget)[0] == copies


def test_a_budget_is_chosen_that_sources_can_fill(spark):
    docs = [(i, "a", 10) for i in range(1000)] + [(2000 + i, "b", 10) for i in range(100)]
    for shortfall, most in ((0.0, 4000), (0.1, 5000), (1.0, 11_000)):  # b has 1,000, twice: half of 4,000, 0.4 of 5,000
        _, shares = mixed(spark, docs, [("a", 0.5, 3), ("b", 0.5, 2)], shortfall=shortfall)
        assert abs(shares["a"]["wanted"] - most / 2) <= 5 and shares["b"]["short"] == (shortfall > 0)


def test_a_document_too_large_for_the_rest_is_passed_over(spark):
    docs = [(i, "a", 1000 if i % 2 else 7) for i in range(60)]
    copies, shares = mixed(spark, docs, [("a", 1.0, 1)], budget=3140)
    assert 3140 * 0.995 <= shares["a"]["reached"] <= 3140 and not shares["a"]["short"]


def test_mixture_of_odd_tables(spark):
    assert mixed(spark, [], [("a", 1.0, 2)])[0] == {}
    assert mixed(spark, [(1, "a", 5)], [])[0] == {}
    copies, shares = mixed(spark, [(1, "a", 5), (2, "a", 5)], [("a", 1.0, None), ("a", 0.5, 1), (None, 1.0, 1)])
    assert copies == {1: 1, 2: 1} and shares["a"]["actual_share"] == 1.0
    copies, _ = mixed(spark, [(1, "a", 5), (2, "a", 5)], [("a", 1.0, 3)], budget=25)
    assert sorted(copies.values()) == [2, 3]
