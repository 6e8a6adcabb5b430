"""Keeping the index: inserts without repeats, the file registry, purges, what is left to enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions.text import basename, doc_hash, sentences, strip


def new_rows(batch: DataFrame, existing: DataFrame, text: str, order: str, hash: str = "doc_hash") -> DataFrame:
    """The rows of ``batch`` whose text is not in ``existing`` (``doc_hash``) nor earlier in the batch, with their hash."""
    w = W.partitionBy(hash).orderBy(order)
    first = batch.withColumn(hash, doc_hash(F.coalesce(F.col(text), F.lit("")))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(existing.select(F.col("doc_hash").alias(hash)).distinct(), hash, "left_anti")


def with_defaults(df: DataFrame) -> DataFrame:
    """Null columns of an index row as they are stored."""
    defaults = {"doc_type": "chunk", "source": "unknown", "level": 1, "media_type": "text", "embedding_valid": True}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns})


def file_states(found: DataFrame, registry: DataFrame, signature: str | Column) -> DataFrame:
    """``filename, state``: new, content_changed, model_changed, unchanged or deleted.

    ``found``: ``filename, file_hash`` on disk; ``registry``: ``filename, file_hash, embed_model``. A null hash
    on either side counts as changed.
    """
    sig = signature if isinstance(signature, Column) else F.lit(signature)
    f = found.select("filename", F.col("file_hash").alias("now"), F.lit(True).alias("here"))
    r = registry.select("filename", F.col("file_hash").alias("was"), "embed_model", F.lit(True).alias("known"))
    both = f.join(r, "filename", "full_outer")
    state = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("here").isNull(), "deleted")
        .when(F.coalesce(F.col("now") != F.col("was"), F.lit(True)), "content_changed")
        .when(~F.col("embed_model").eqNullSafe(sig), "model_changed")
        .otherwise("unchanged")
    )
    return both.select("filename", state.alias("state"))


def upsert_registry(registry: DataFrame, files: DataFrame, signature: str) -> DataFrame:
    """The registry after indexing ``files`` (``filename, file_hash``): hash and signature replaced or added."""
    f = files.select("filename", F.col("file_hash").alias("_new"), F.lit(True).alias("_hit"))
    both = registry.select("filename", "file_hash", "embed_model").join(f, "filename", "full_outer")
    hit = F.col("_hit").isNotNull()
    return both.select("filename", F.when(hit, F.col("_new")).otherwise(F.col("file_hash")).alias("file_hash"), F.when(hit, F.lit(signature)).otherwise(F.col("embed_model")).alias("embed_model"))


def purge_files(docs: DataFrame, filenames: DataFrame) -> DataFrame:
    """The rows whose source is none of ``filenames`` (``filename``), compared by their last part: a join, not a search inside every path."""
    gone = filenames.select(basename(F.col("filename")).alias("_b")).distinct()
    return docs.withColumn("_b", basename(F.col("source"))).join(gone, "_b", "left_anti").drop("_b")


def unenriched(docs: DataFrame) -> DataFrame:
    """Chunks (level 1, no images) that no proposition refers to."""
    chunks = docs.where((F.col("level") == 1) & F.coalesce(F.col("media_type") != "image", F.lit(False)))
    done = docs.where("level = 0 and parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return chunks.join(done, "id", "left_anti")


def without_summaries(docs: DataFrame) -> DataFrame:
    """What stays when summaries are rebuilt: everything below level 2, and rows of no level."""
    return docs.where(F.col("level").isNull() | (F.col("level") < 2))


def propositions(chunks: DataFrame, least: int = 20) -> DataFrame:
    """Level 0 rows of chunks (``id, content``): sentences, or the chunk itself if it is short; with a hash of chunk and text."""
    s = F.filter(F.transform(sentences(F.col("content")), strip), lambda x: x != "")
    each = F.when(F.length("content") < least, F.array("content")).otherwise(s)
    return chunks.select(F.col("id").alias("parent_id"), F.posexplode(each).alias("no", "content")).select(
        "parent_id", "no", "content", F.lit(0).alias("level"), doc_hash(F.concat(F.col("parent_id").cast("string"), F.lit("_"), F.col("content"))).alias("doc_hash")
    )


def cluster_summaries(docs: DataFrame, cluster: str, first: int = 8, chars: int = 600) -> DataFrame:
    """``cluster, n, summary`` of clusters of two or more rows (``id, content``): the first members' beginnings under a heading.

    Sizes are counted apart from the members kept, so no cluster is brought together.
    """
    sizes = docs.groupBy(cluster).agg(F.count("*").alias("n")).where("n >= 2")
    kept = docs.withColumn("_r", F.row_number().over(W.partitionBy(cluster).orderBy("id"))).where(F.col("_r") <= first)
    body = kept.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("_r", F.substring("content", 1, chars).alias("t")))).alias("l"))
    return sizes.join(body, cluster).select(F.col(cluster).alias("cluster"), "n", F.concat(F.lit("[Cluster Summary — "), F.col("n").cast("string"), F.lit(" chunks]\n"), F.array_join("l.t", "\n\n")).alias("summary"))
