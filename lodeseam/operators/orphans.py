"""References to records that do not exist.

The parent keys are compressed into contiguous runs; every distinct referenced key is matched as-of to
the run that starts at or before it and is an orphan if it lies beyond that run's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.session import hot_keys, salted_lookup

#: Runs are formed within blocks of 2**BLOCK_BITS key values, which bounds every window's group.
BLOCK_BITS = 16


def key_runs(ids: DataFrame, column: str) -> DataFrame:
    """``block, first, last``: the contiguous runs of the integer keys in ``column`` (nulls and repeats ignored).

    A run never crosses a block, so a group holds at most 2**BLOCK_BITS rows; an empty table has no runs.
    """
    keys = ids.select(F.col(column).cast("bigint").alias("k")).where("k is not null").distinct()
    keys = keys.withColumn("block", F.shiftright("k", BLOCK_BITS))
    w = Window.partitionBy("block").orderBy("k")
    return (
        keys.withColumn("island", F.col("k") - F.row_number().over(w))
        .groupBy("block", "island")
        .agg(F.min("k").alias("first"), F.max("k").alias("last"))
        .select("block", "first", "last")
    )


def match_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``present`` to ``keys`` (distinct, in column ``ref``): is the key inside the run before it?"""
    k = keys.withColumn("block", F.shiftright("ref", BLOCK_BITS)).withColumn("at", F.col("ref")).withColumn("kind", F.lit(1))
    none = [F.lit(None).cast(t).alias(c) for c, t in keys.dtypes]
    r = runs.select(*none, "block", F.col("first").alias("at"), F.lit(0).alias("kind"), "first", "last")
    both = k.withColumns({"first": F.lit(None).cast("bigint"), "last": F.lit(None).cast("bigint")}).unionByName(r)
    # as-of: the latest run start at or before the key; a run sorts before a key of the same value
    w = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("end", F.last("last", ignorenulls=True).over(w)).where("kind = 1")
    return seen.select(*keys.columns, F.coalesce(F.col("ref") <= F.col("end"), F.lit(False)).alias("present"))


def references(df: DataFrame, tab: str, id: str, ref: str, at: str) -> DataFrame:
    """``tab, id, ref, at`` of the rows of one table that refer to something; rows delivered twice count once."""
    return (
        df.select(F.lit(tab).alias("tab"), F.col(id).cast("bigint").alias("id"), F.col(ref).cast("bigint").alias("ref"), F.col(at).alias("at"))
        .where("ref is not null")
        .distinct()
    )


def period_of(at: Column) -> Column:
    """``yyyy-MM`` of a timestamp without time zone, ``none`` if null."""
    return F.coalesce(F.substring(at.cast("string"), 1, 7), F.lit("none"))


def find_orphans(refs: DataFrame, targets: DataFrame, purges: DataFrame) -> DataFrame:
    """Every bad reference as ``tab, id, ref, reason, period``.

    ``refs``: see :func:`references`. ``targets``: ``id, at`` of the rows referred to (repeats allowed; the
    earliest time counts). ``purges``: ``id, at`` of logged removals. Reasons, the first that holds:
    ``deleted`` (absent but logged as removed, or removed at or after the stored row's time), ``missing``
    (absent), ``late`` (stored only after the referring row). Null times decide nothing and have the
    period ``none``; empty tables are fine: without targets every reference is missing or deleted.
    A key referred to by a third of all rows is looked up once and joined back over salted tasks.
    """
    keys = refs.groupBy("ref").agg(F.count("*").alias("n"))
    keys = match_runs(keys, key_runs(targets, "id"))
    stored = targets.where("id is not null").groupBy(F.col("id").cast("bigint").alias("ref")).agg(F.min("at").alias("target_at"))
    logged = purges.where("id is not null").groupBy(F.col("id").cast("bigint").alias("ref")).agg(F.max("at").alias("purged_at"), F.lit(True).alias("logged"))
    # absent keys have no stored row, so a left join leaves their target_at null
    keys = keys.join(stored, "ref", "left").join(logged, "ref", "left")
    gone = F.when(F.col("present"), F.col("purged_at") >= F.col("target_at")).otherwise(F.col("logged"))
    keys = keys.select(
        "ref",
        F.when(F.coalesce(gone, F.lit(False)), "deleted").when(~F.col("present"), "missing").alias("key_reason"),
        "target_at",
    ).where("key_reason is not null or target_at is not null")
    rows = salted_lookup(refs, keys, "ref", "id", hot_keys(refs, "ref"), "inner")
    reason = F.coalesce("key_reason", F.when(F.col("target_at") > F.col("at"), "late"))
    return rows.select("tab", "id", "ref", reason.alias("reason"), period_of(F.col("at")).alias("period")).where("reason is not null")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, reason and period."""
    return orphans.groupBy("tab", "reason", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("ref").alias("n_keys"))
