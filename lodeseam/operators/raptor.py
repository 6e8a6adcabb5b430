"""Trees of summaries: clusters of vectors are summarised, and the summaries clustered again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators.cluster import cluster_vectors
from lodeseam.operators.maintenance import cluster_summaries
from lodeseam.providers import EmbeddingProvider, embed
from lodeseam.session import cut_lineage


def build_tree(chunks: DataFrame, max_level: int = 3, least: int = 11, least_above: int = 3, provider: EmbeddingProvider | None = None) -> DataFrame:
    """``level, cluster, n, content`` of the summaries above ``chunks`` (``id, content, v``), level by level.

    The chunks are clustered if there are at least ``least``, the summaries of a level from ``least_above`` on;
    clusters of one row are left out. Every level is written before the next.
    """
    out: list[DataFrame] = []
    level = cut_lineage(chunks.select("id", "content", F.col("v").cast("array<double>").alias("v")))
    for no in range(2, max_level + 1):
        if level.count() < (least if no == 2 else least_above):
            break
        labelled = level.select("id", "content").join(cluster_vectors(level.select("id", "v")), "id")
        made = cut_lineage(cluster_summaries(labelled, "cluster").select(F.lit(no).alias("level"), "cluster", "n", F.col("summary").alias("content")))
        out.append(made)
        level = cut_lineage(made.select(F.col("cluster").cast("bigint").alias("id"), "content", embed(F.col("content"), provider).alias("v")))
    empty = chunks.sparkSession.createDataFrame([], "level int, cluster int, n bigint, content string")
    return reduce(DataFrame.unionByName, out, empty)
