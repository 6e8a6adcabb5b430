"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.session import cut_lineage, hot_keys, salted_lookup


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex passes its larger (``large``) or smaller neighbours on to the smallest of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = salted_lookup(both, least.select("u", "m"), "u", "v", hot_keys(both, "u"), "inner")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id) for every vertex of ``edges`` (``a, b``); vertices of hubs are salted.

    Rounds of a large star and a small star, each written to the checkpoint folder, until nothing changes;
    their number grows with the logarithm of the vertices.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        e = cut_lineage(_star(_star(e, large=True), large=False).where("u <> v").distinct(), looped=True)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
