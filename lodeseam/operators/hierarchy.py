"""Parent-child links to full hierarchies.

Deterministic hash splitters cut every upward chain into short stretches. Each node walks to its next
splitter (the walk doubles its length per round). The graph of splitters alone is then solved by pointers that
double their reach, carrying a few numbers and no paths; pointers that never end lie on cycles or below them. Exact
paths are put together from the stretches last, and only if they are asked for. Chains that never meet a splitter run into a
splitterless cycle, which the first phase recognises by a node meeting itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.session import cut_lineage, hot_keys, salted_lookup

#: One node in SPLIT_EVERY is a splitter, and every top node. A stretch is about so long; one of 40 times that is met once in 200 million million nodes.
SPLIT_EVERY = 8


def _split(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SPLIT_EVERY)) == 0


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _part(active: DataFrame, done: list[DataFrame]) -> tuple[DataFrame, int]:
    """(rows of ``active`` that go on, their number); those that stop are written apart, once, and put to ``done``."""
    n = {r["stop"]: r["count"] for r in active.groupBy("stop").count().collect()}
    if not done or n.get(True):
        done.append(active.where("stop") if not n.get(False) else cut_lineage(active.where("stop"), looped=True))
    return active.where("not stop"), n.get(False, 0)


def _walk(state: DataFrame) -> DataFrame:
    """Follow ``ptr`` to the next splitter, doubling the stretch ``seg`` per round.

    Columns: id, ptr, seg (ids from this row up to just below ptr), stop, on (lies on a splitterless cycle), cyc
    (smallest id of the splitterless cycle that the row reaches). Rows that stop are written once.
    """
    done: list[DataFrame] = []
    active = cut_lineage(state)
    while True:
        going, n = _part(active, done)
        if not n:
            return _all(done)
        ahead = _all([*done, going]).select(
            F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seg").alias("seg2"), F.col("stop").alias("stop2"), F.col("cyc").alias("cyc2")
        )
        step = salted_lookup(going, ahead, "ptr", "id", hot_keys(going, "ptr", n), "inner")
        step = step.withColumn("walked", F.when(F.col("cyc2").isNotNull(), F.col("seg")).otherwise(F.concat("seg", "seg2")))
        # where this row meets itself again: beyond its own place at the front, or as the next pointer
        again = F.array_position(F.expr("slice(walked, 2, greatest(size(walked) - 1, 1))"), F.col("id"))
        ring = F.when(again > 0, F.slice("walked", F.lit(1), again.cast("int"))).when(F.col("ptr2") == F.col("id"), F.col("walked"))
        # one that stops at a splitter, itself perhaps, is left to the reduced graph
        step = step.withColumn("ring", F.when(~F.col("stop2"), ring))
        cyc = F.coalesce("cyc2", F.array_min("ring"))
        active = cut_lineage(
            step.select(
                "id",
                F.when(F.col("cyc2").isNull(), F.col("ptr2")).otherwise(F.col("ptr")).alias("ptr"),
                F.when(cyc.isNull(), F.col("walked")).otherwise(F.array("id")).alias("seg"),
                (F.col("stop2") | cyc.isNotNull()).alias("stop"),
                F.col("ring").isNotNull().alias("on"),
                cyc.alias("cyc"),
            ),
            looped=True,
        )


def _solve(state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(ended, endless) of the reduced graph: ``id, root, steps, cyc`` of the pointers that end, ``id, ptr, low`` of the others.

    ``state``: id, ptr, low (smallest id of the stretch), steps (its length), root (of a top row, itself), cyc.
    A pointer that has not ended after as many hops as there were pointers left never does; it then points to a
    row on its cycle, and on a cycle ``low`` covers all of it.
    """
    done: list[DataFrame] = []
    active = cut_lineage(state.withColumn("stop", F.col("root").isNotNull() | F.col("cyc").isNotNull()))
    hops, bound = 1, None
    while True:
        going, m = _part(active, done)
        bound = hops + m if bound is None else min(bound, hops + m)
        if not m or hops >= bound:
            return _all(done).select("id", "root", "steps", "cyc"), going.select("id", "ptr", "low") if m else None
        ahead = _all([*done, going]).select(F.col("id").alias("ptr"), *[F.col(c).alias(f"{c}2") for c in ("ptr", "low", "steps", "root", "cyc", "stop")])
        step = salted_lookup(going, ahead, "ptr", "id", hot_keys(going, "ptr", m), "inner")
        active = cut_lineage(
            step.select(
                "id",
                F.col("ptr2").alias("ptr"),
                F.least("low", "low2").alias("low"),
                (F.col("steps") + F.col("steps2")).alias("steps"),
                F.col("root2").alias("root"),
                F.col("cyc2").alias("cyc"),
                F.col("stop2").alias("stop"),
            ),
            looped=True,
        )
        hops *= 2


def _expand(chains: DataFrame) -> DataFrame:
    """``id, rest``: the ids from every splitter up to its top row, from the stretches ``seg`` up to ``ptr`` (null at the top)."""
    done: list[DataFrame] = []
    active = cut_lineage(chains.select("id", "ptr", "seg", F.col("ptr").isNull().alias("stop")))
    while True:
        going, m = _part(active, done)
        if not m:
            return _all(done).select("id", F.col("seg").alias("rest"))
        ahead = _all([*done, going]).select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seg").alias("seg2"))
        step = salted_lookup(going, ahead, "ptr", "id", hot_keys(going, "ptr", m), "inner")
        active = cut_lineage(step.select("id", F.col("ptr2").alias("ptr"), F.concat("seg", "seg2").alias("seg"), F.col("ptr2").isNull().alias("stop")), looped=True)


def resolve_hierarchy(rows: DataFrame, id: str = "id", parent: str = "parent_id", paths: bool = True) -> DataFrame:
    """One row per id: ``id, root_id, depth, path, cycle_id, place``; without ``paths`` no path is put together, and the column is missing.

    ``path`` runs from the top row to the row itself, ``depth`` is 0 at the top. Rows whose chain never ends
    have a null path, depth and root, the smallest id of the cycle as ``cycle_id`` and ``place`` ``on`` or
    ``below``. Rows with a null id are left out; of rows that repeat an id with different parents the
    smallest parent counts; a parent without a row ends the chain. Other columns are not looked at.
    Lookups of a parent shared by very many rows are salted. Without paths the work is linear in the rows, per
    round, whatever the length of chains and cycles; paths are as long as they are.
    """
    base = rows.select(F.col(id).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("up")).where("id is not null")
    base = cut_lineage(base.groupBy("id").agg(F.min("up").alias("up")))
    n = base.count()
    hot = hot_keys(base, "up", n)
    # does the parent exist, and is it a top row (which is a splitter)?
    tops = base.select(F.col("id").alias("up"), F.col("up").alias("up2"))
    nodes = salted_lookup(base, tops.withColumn("there", F.lit(True)), "up", "id", hot)
    nodes = cut_lineage(nodes.select("id", F.when(F.col("there"), F.col("up")).alias("ptr"), F.col("up2")))
    # a parent is a top row if it has no parent, or one that has no row
    roots = nodes.where("ptr is null").select(F.col("id").alias("ptr"), F.lit(True).alias("top"))
    start = salted_lookup(nodes.select("id", "ptr"), roots, "ptr", "id", hot)
    start = start.select(
        "id",
        "ptr",
        F.array("id").alias("seg"),
        (F.col("ptr").isNull() | F.coalesce("top", F.lit(False)) | _split(F.col("ptr"))).alias("stop"),
        F.lit(False).alias("on"),
        F.lit(None).cast("bigint").alias("cyc"),
    )
    walked = cut_lineage(_walk(start))
    # the reduced graph: splitters and top rows only
    is_end = F.col("ptr").isNull() | _split(F.col("id"))
    reduced = walked.where(is_end)
    ended, endless = _solve(
        reduced.select("id", "ptr", F.array_min("seg").alias("low"), F.size("seg").alias("steps"), F.when(F.col("ptr").isNull(), F.col("id")).alias("root"), "cyc")
    )
    ends = ended.withColumn("on", F.lit(False))
    on_ring = None
    if endless is not None:
        # the rows pointed to are those on cycles; their stretches are the cycles
        rings = endless.join(endless.select(F.col("ptr").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("ptr"), F.col("low").alias("cyc"))
        found = salted_lookup(endless.select("id", "ptr"), rings, "ptr", "id", hot_keys(endless, "ptr"), "inner")
        on = rings.select(F.col("ptr").alias("id"), F.lit(True).alias("ring"))
        ends = ends.unionByName(
            found.join(on, "id", "left").select("id", F.lit(None).cast("bigint").alias("root"), F.lit(None).cast("int").alias("steps"), "cyc", F.coalesce("ring", F.lit(False)).alias("on"))
        )
        on_ring = walked.where(_split(F.col("id"))).join(on.select("id"), "id", "left_semi").select(F.explode("seg").alias("id"), F.lit(True).alias("ring"))
    ends = cut_lineage(ends)
    if paths:
        upward = reduced.join(ended.where("root is not null").select("id"), "id", "left_semi")
        ends = cut_lineage(ends.join(_expand(upward), "id", "left"))
    # everything below: its own stretch, then what its splitter has
    others = walked.where(~is_end)
    m = others.count()
    rest = ["rest"] if paths else []
    below = salted_lookup(
        others.where("cyc is null").select("id", "ptr", F.size("seg").alias("own"), *(["seg"] if paths else [])),
        ends.select(F.col("id").alias("ptr"), "root", "steps", "cyc", *rest),
        "ptr",
        "id",
        hot_keys(others, "ptr", m),
        "inner",
    )
    if on_ring is None:
        below = below.withColumn("on", F.lit(False))
    else:
        below = below.join(on_ring, "id", "left").withColumn("on", F.coalesce("ring", F.lit(False)))
    if paths:
        below = below.withColumn("rest", F.concat("seg", "rest"))
    below = below.select("id", "root", (F.col("steps") + F.col("own")).alias("steps"), "cyc", "on", *rest)
    lost = others.where("cyc is not null").select("id", F.lit(None).cast("bigint").alias("root"), F.lit(None).cast("int").alias("steps"), "cyc", "on", *[F.lit(None).cast("array<bigint>").alias(c) for c in rest])
    whole = ends.unionByName(below).unionByName(lost)
    return whole.select(
        "id",
        F.col("root").alias("root_id"),
        F.when(F.col("root").isNotNull(), F.col("steps") - 1).alias("depth"),
        *[F.reverse("rest").alias("path") for _ in rest],
        F.col("cyc").alias("cycle_id"),
        F.when(F.col("cyc").isNotNull(), F.when(F.col("on"), "on").otherwise("below")).alias("place"),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """``ancestor_id, id, distance`` for every row below every row, from the exact paths; cycles have none."""
    up = resolved.where("path is not null and depth > 0").select("id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "ancestor_id"))
    return up.select("ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance"))
