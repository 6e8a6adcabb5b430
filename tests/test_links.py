"""Missing references and hierarchies against brute force, and their defined results in odd cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import lodeseam.session as session
from lodeseam.operators.hierarchy import descendants, resolve_hierarchy
from lodeseam.operators.orphans import find_orphans, key_runs, orphan_report, references

T = "tab string, id bigint, ref bigint, at timestamp_ntz"


def day(n):
    return None if n is None else dt.datetime(2024, 1 + n % 12, 1)


def test_runs_compress_keys(spark):
    keys = [-3, -2, -1, 0, 5, 6, 7, 7, None, 65535, 65536, 65537]
    runs = sorted((r["first"], r["last"]) for r in key_runs(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k").collect())
    # a run ends at the edge of a block of keys
    assert runs == [(-3, -1), (0, 0), (5, 7), (65535, 65535), (65536, 65537)]


@pytest.mark.parametrize("hot", [False, True])
def test_orphans_like_brute_force(spark, hot, monkeypatch):
    rng = random.Random(3)
    targets = {i: rng.choice([None, *range(12)]) for i in rng.sample(range(400), 250)}
    purges = [(rng.randrange(420), rng.choice([None, *range(12)])) for _ in range(60)]
    refs = [(t, i, 7 if hot and i % 3 else rng.randrange(430), rng.choice([None, *range(12)])) for t in ("a", "b") for i in range(300)]
    if hot:  # the key of most rows is looked up over salted tasks
        monkeypatch.setattr(session, "HOT_FLOOR", 10)
        assert session.hot_keys(spark.createDataFrame(refs, "t string, id long, ref long, at int"), "ref") == [7]
    want = set()
    for t, i, r, at in refs:
        gone = [p for k, p in purges if k == r]
        if r in targets:
            made = targets[r]
            if made is not None and any(p is not None and day(p) >= day(made) for p in gone):
                reason = "deleted"
            elif made is not None and at is not None and day(made) > day(at):
                reason = "late"
            else:
                continue
        else:
            reason = "deleted" if gone else "missing"
        want.add((t, i, r, reason, "none" if at is None else day(at).strftime("%Y-%m")))
    got = find_orphans(
        spark.createDataFrame([(t, i, r, day(a)) for t, i, r, a in refs], T),
        spark.createDataFrame([(i, day(a)) for i, a in targets.items()], "id bigint, at timestamp_ntz"),
        spark.createDataFrame([(i, day(a)) for i, a in purges], "id bigint, at timestamp_ntz"),
    )
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert orphan_report(got).agg(F.sum("n_refs")).first()[0] == len(want)


def test_orphans_of_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "id bigint, at timestamp_ntz")
    src = spark.createDataFrame([(1, 9, day(1), "x", 5), (1, 9, day(1), "x", 5), (2, None, None, "y", 6)], "id bigint, up bigint, made timestamp_ntz, ref string, first bigint")
    refs = references(src, "src", "id", "up", "made")
    assert [tuple(r) for r in find_orphans(refs, none, none).collect()] == [("src", 1, 9, "missing", "2024-02")]
    assert find_orphans(spark.createDataFrame([], T), none, none).count() == 0


def brute(parents):
    out = {}
    for i in parents:
        path, seen, cur = [], {}, i
        while cur is not None and cur in parents and cur not in seen:
            seen[cur] = len(path)
            path.append(cur)
            cur = parents[cur]
        if cur is not None and cur in seen:
            ring = path[seen[cur] :]
            out[i] = (None, None, None, min(ring), "on" if i in ring else "below")
        else:
            out[i] = (path[-1], len(path) - 1, path[::-1], None, None)
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "rings", "star"])
def test_hierarchy_like_brute_force(spark, kind, monkeypatch):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 600)
    if kind == "random":
        parents = {i: rng.choice([None, *rng.choices(ids, k=30), 99_999]) for i in ids}
    elif kind == "chain":
        parents = {i: (ids[k - 1] if k else None) for k, i in enumerate(ids)}
    elif kind == "star":
        monkeypatch.setattr(session, "HOT_FLOOR", 50)
        parents = {i: (ids[0] if k else None) for k, i in enumerate(ids)}
    else:  # rings of all lengths, with and without splitters, and tails
        parents, at = {}, 0
        for n in [1, 1, 2, 3, 5, 8, 13, 40, 100]:
            ring = ids[at : at + n]
            parents |= {x: ring[(k + 1) % n] for k, x in enumerate(ring)}
            at += n
        for x in ids[at:]:
            parents[x] = rng.choice(list(parents))
    rows = [(i, p, "x", 1) for i, p in parents.items()]
    got = resolve_hierarchy(spark.createDataFrame([*rows, *rows[:50], (None, 3, "x", 1)], "id bigint, parent_id bigint, path string, depth int"))
    have = {r["id"]: (r["root_id"], r["depth"], r["path"], r["cycle_id"], r["place"]) for r in got.collect()}
    assert got.count() == len(have) and have == brute(parents)
    bare = resolve_hierarchy(spark.createDataFrame(rows, "id bigint, parent_id bigint, path string, depth int"), paths=False)
    assert {r["id"]: (r["root_id"], r["depth"], r["cycle_id"], r["place"]) for r in bare.collect()} == {i: (*v[:2], *v[3:]) for i, v in brute(parents).items()}
    pairs = {(r["ancestor_id"], r["id"], r["distance"]) for r in descendants(got).collect()} if kind == "random" else None
    if pairs is not None:
        assert pairs == {(a, i, len(v[2]) - 1 - k) for i, v in brute(parents).items() if v[2] for k, a in enumerate(v[2][:-1])}


def test_a_long_cycle_and_a_long_chain_cost_no_more_than_their_rows(spark):
    n = 20_000  # ids in no order; a ring of n rows, and n rows hanging below it in one chain
    at = F.pmod(F.col("id") * 7919, F.lit(n))
    ring = spark.range(n).select(at.alias("id"), F.pmod((F.col("id") + 1) * 7919, F.lit(n)).alias("parent_id"))
    tail = spark.range(n).select((F.col("id") + n).alias("id"), F.when(F.col("id") > 0, F.col("id") + n - 1).otherwise(5).alias("parent_id"))
    got = resolve_hierarchy(ring.unionByName(tail), paths=False).groupBy("cycle_id", "place").count().collect()
    assert {tuple(r) for r in got} == {(0, "on", n), (0, "below", n)}


def test_hierarchy_of_nothing(spark):
    assert resolve_hierarchy(spark.createDataFrame([], "id bigint, parent_id bigint")).count() == 0
