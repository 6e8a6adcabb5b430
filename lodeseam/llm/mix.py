"""Mixing sources to target weights by nested hash-threshold histograms, without sorting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.session import cut_lineage, salted_lookup

#: A document's hash has three parts of this many bits; each part is one level of the histogram.
PART_BITS = 10
PARTS = 3
#: Up to so many sources are broadcast (rows of a few numbers); beyond that they are joined over salted tasks.
BROADCAST_SOURCES = 20_000
#: Part of the budget that sources with documents may miss by default, as they cannot be repeated often enough.
SHORTFALL = 0.1
#: Part of a source's size that may be missing without it counting as short.
SLACK = 0.005
#: Budgets tried at once.
GRID = 32


def _with_sources(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """``docs`` with the columns of ``sources``; a source may hold any share of the documents."""
    if n_sources <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(sources), "source", "inner")
    from lodeseam.session import hot_keys

    return salted_lookup(docs, sources, "source", "key", hot_keys(docs, "source"), "inner")


def feasible_budget(have: DataFrame, shortfall: float) -> float:
    """The largest budget, up to all that is available, of which the sources with documents miss at most ``shortfall``.

    ``have``: ``target_share, available, max_repeats``. What is missed grows with the budget, so it is found on a grid
    of budgets, refined twice; each time one pass over the sources, none of which reaches the driver.
    """
    low, high = 0.0, float(have.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0])
    some = have.where("available > 0")
    for _ in range(3):
        grid = [low + (high - low) * i / GRID for i in range(1, GRID + 1)]
        missed = [F.sum(F.greatest(F.lit(0.0), F.col("target_share") * F.lit(b) - F.col("available") * F.col("max_repeats"))) for b in grid]
        got = some.agg(F.array(*missed).alias("m")).first()["m"]
        fits = [(m or 0.0) <= shortfall * b for m, b in zip(got, grid, strict=True)]
        if all(fits):
            return high
        at = fits.index(False)
        low, high = (grid[at - 1] if at else low), grid[at]
    return low


def _threshold(docs: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """``source, lo, most, below, left, full``: up to which hash the documents of each source fit, as far as they come after ``lo`` and are no larger than ``most``.

    ``state``: ``source, lo, most``. A histogram of sizes over hash buckets, refined within the boundary bucket only, twice.
    ``left`` is what remains, ``full`` whether a document beyond did not fit.
    """
    state = state.select("source", "lo", "most", F.col("most").alias("left"), F.lit(0).cast("bigint").alias("below"), F.lit(True).alias("full"))
    for part in range(PARTS):
        shift = PART_BITS * (PARTS - 1 - part)
        # only documents in the boundary bucket so far: all at first
        inside = _with_sources(docs, state.where("full"), n_sources).where((F.col("h") >= F.col("lo")) & (F.col("size") <= F.col("most")))
        inside = inside.where(F.shiftright(F.col("h"), shift + PART_BITS) == F.shiftright(F.col("below"), shift + PART_BITS))
        histogram = inside.groupBy("source", F.shiftright(F.col("h"), shift).alias("bucket")).agg(F.sum("size").alias("sum"))
        running = histogram.withColumn("upto", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")))
        # the first bucket that no longer fits; what lies before it is taken. Per source at most 2**PART_BITS rows.
        over = F.col("upto") > F.col("left")
        found = state.join(running, "source", "left").groupBy("source", "lo", "most", "left", "below", "full").agg(
            F.min(F.when(over, F.col("bucket"))).alias("boundary"), F.max(F.when(~over, F.col("upto"))).alias("taken")
        )
        last = F.shiftleft(F.shiftright(F.col("below"), shift + PART_BITS) + 1, PART_BITS)
        below = F.when(F.col("full"), F.shiftleft(F.coalesce("boundary", last), shift)).otherwise(F.col("below"))
        state = cut_lineage(
            found.select("source", "lo", "most", (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"), below.alias("below"), (F.col("full") & F.col("boundary").isNotNull()).alias("full")), looped=True
        )
    return state


def plan_mixture(docs: DataFrame, targets: DataFrame, budget: float | None = None, shortfall: float = SHORTFALL) -> tuple[DataFrame, DataFrame]:
    """(selected, wanted) of a mixture; :func:`mixture_shares` reports what is reached.

    ``docs``: ``key, source, size``; ``targets``: ``source, target_share, max_repeats`` (one row per source;
    of repeats the largest share counts; a null or negative share counts 0, a null max_repeats 1).
    ``budget``: total size, by default the :func:`feasible_budget` for ``shortfall``: the smaller that is, the closer
    the shares come to the targets, and the smaller the mixture is. Each source gets
    ``floor(wanted / available)`` whole rounds, at most max_repeats, and as the rest the documents whose hash
    lies below a threshold (:func:`_threshold`). The document that no longer fits is passed over and the search goes on behind it with those that do,
    until less than ``SLACK`` of the source's size is missing, or nothing fits. Documents of one hash stay together.
    ``selected``: ``key, source, size, copies`` with copies >= 1. ``wanted``: each source of ``targets`` with
    the sizes available and wanted; sources without documents appear with 0. Documents without a source or
    with a source that is not wanted are in neither result; documents of size 0 come with any round.
    """
    wanted = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.max(F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1))).alias("max_repeats"))
    )
    n_sources = wanted.count()
    docs = docs.where("source is not null").withColumn("h", F.pmod(F.xxhash64("key"), F.lit(1 << (PART_BITS * PARTS))))
    docs = cut_lineage(_with_sources(docs, wanted.select("source"), n_sources))
    have = wanted.join(docs.groupBy("source").agg(F.sum("size").alias("available"), F.count("*").alias("n_docs")), "source", "left").na.fill(0, ["available", "n_docs"])
    have = cut_lineage(have)
    budget = feasible_budget(have, shortfall) if budget is None else float(budget)
    want = F.col("target_share") * F.lit(budget)
    rounds = F.when(F.col("available") > 0, F.least(F.floor(want / F.col("available")), F.col("max_repeats"))).otherwise(F.lit(0)).cast("int")
    part = F.when(F.col("rounds") < F.col("max_repeats"), want - F.col("rounds") * F.col("available")).otherwise(F.lit(0.0))
    state = cut_lineage(have.withColumn("rounds", rounds).select("source", "rounds", part.alias("most"), (SLACK * want).alias("slack")))
    # stretches of hashes, each with the largest size that it takes; later ones fill what the one before left
    stretches, todo, pool = [], state.where("most > 0").select("source", F.lit(0).cast("bigint").alias("lo"), "most", "slack"), docs
    while True:
        found = _threshold(pool, todo.select("source", "lo", "most"), n_sources)
        stretches.append(found.select("source", "lo", "below", "most"))
        todo = cut_lineage(found.join(todo.select("source", "slack"), "source").where("full and left > slack").select("source", (F.col("below") + 1).alias("lo"), F.col("left").alias("most"), "slack"), looped=True)
        pool = cut_lineage(_with_sources(pool.select("key", "source", "size", "h"), todo, n_sources).where("h >= lo and size <= most and size > 0").select("key", "source", "size", "h"), looped=True)
        if pool.isEmpty():
            break
    per = reduce(DataFrame.unionByName, stretches).groupBy("source").agg(F.collect_list(F.struct("lo", "below", "most")).alias("stretches"))
    plan = cut_lineage(state.select("source", "rounds").join(per, "source", "left").join(have.select("source", "max_repeats"), "source"))
    inside = F.exists("stretches", lambda x: (F.col("h") >= x["lo"]) & (F.col("h") < x["below"]) & (F.col("size") <= x["most"]))
    copies: Column = F.col("rounds") + F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    # a source at its cap takes no part of another round
    chosen = _with_sources(docs, plan, n_sources)
    selected = chosen.withColumn("copies", F.least(copies, "max_repeats").cast("int")).where("copies > 0").select("key", "source", "size", "copies")
    return selected, have.select("source", "target_share", "max_repeats", "n_docs", "available", want.alias("wanted"))


def mixture_shares(selected: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source what was wanted and reached, and its share of the mixture; ``short``: more than ``SLACK`` of what was wanted is missing."""
    got = selected.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("reached"), F.sum("copies").alias("n_rows"))
    got = cut_lineage(wanted.join(got, "source", "left").na.fill(0, ["reached", "n_rows"]))
    total = got.agg(F.sum("reached")).first()[0] or 0
    share = F.col("reached") / F.lit(total) if total else F.lit(None).cast("double")
    of_budget = F.when(F.col("wanted") > 0, F.col("target_share") * F.col("reached") / F.col("wanted"))
    return got.select("*", of_budget.alias("budget_share"), share.alias("actual_share"), (F.col("reached") < (1 - SLACK) * F.col("wanted")).alias("short"))
