"""Building an index from a folder, again and again: only new and changed files are read, and stale rows go."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.operators import chunk, maintenance
from lodeseam.providers import EmbeddingProvider, embed, mask_failures
from lodeseam.schema import TABLES
from lodeseam.session import cut_lineage
from lodeseam.settings import Settings
from lodeseam.sources import files


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _current(spark: SparkSession, store: str, name: str) -> str | None:
    """The folder of the version that counts, or none."""
    fs, p = _fs(spark, os.path.join(store, name))
    versions = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    done = sorted(v for v in versions if v.startswith("v") and fs.exists(_fs(spark, os.path.join(store, name, v, "_SUCCESS"))[1]))
    return os.path.join(store, name, done[-1]) if done else None


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store as of its last finished version, empty if it is not there yet."""
    at = _current(spark, store, name)
    return spark.read.schema(TABLES[name]).parquet(at) if at else spark.createDataFrame([], TABLES[name])


def replace_table(df: DataFrame, store: str, name: str) -> None:
    """Write a new version beside the old one. It counts from the moment its last file, which marks it as finished, is there; older ones go after that.

    Readers, and a run that is broken off anywhere, see the one or the other, whole.
    """
    spark = df.sparkSession
    old = _current(spark, store, name)
    no = int(os.path.basename(old)[1:]) + 1 if old else 0
    new = f"v{no:012d}"
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(os.path.join(store, name, new))
    fs, folder = _fs(spark, os.path.join(store, name))
    for x in fs.listStatus(folder):
        if x.getPath().getName() < new:
            fs.delete(x.getPath(), True)


def append_table(df: DataFrame, store: str, name: str) -> None:
    """Add rows to a table of the store, in a new version of it."""
    before = read_table(df.sparkSession, store, name)
    replace_table(before.unionByName(df.select(*before.columns)), store, name)


def chunk_units(units: DataFrame) -> DataFrame:
    """Level 1 chunks of file units: tables by rows, images as they are, all else as children of parents."""
    keep = ["source", "page", "doc_type", "media_type", "media_path"]
    image, tab = F.col("media_type") == "image", F.coalesce(F.col("doc_type") == "table", F.lit(False))
    cells = units.where(tab & ~image).select(*keep, F.posexplode(chunk.table_chunks(F.col("text"))).alias("no", "c")).select(*keep, "no", F.lit(None).cast("int").alias("parent_no"), F.col("c.text").alias("content"))
    pictures = units.where(image).select(*keep, F.lit(0).alias("no"), F.lit(None).cast("int").alias("parent_no"), F.col("text").alias("content"))
    prose = chunk.parent_child(units.where(~tab & ~image).select(*keep, "text"), "text").select(*keep, F.col("child_id").alias("no"), "parent_no", F.col("child").alias("content"))
    return prose.unionByName(cells).unionByName(pictures)


def build_index(spark: SparkSession, folder: str, store: str, force: bool = False, settings: Settings | None = None, provider: EmbeddingProvider | None = None) -> DataFrame:
    """``filename, state, error`` of what was found, after bringing ``documents`` and ``indexed_files`` of ``store`` up to date.

    New and changed files (by content or by model) are loaded, chunked, embedded and added without repeating a
    text that is there; rows of changed and deleted files are removed first. ``force`` indexes everything anew.
    """
    settings = settings or Settings()
    found = cut_lineage(files.list_files(spark, folder).select(F.col("path").alias("filename"), files.file_hash(F.col("content")).alias("file_hash")))
    registry = read_table(spark, store, "indexed_files")
    registry = cut_lineage(registry.limit(0) if force else registry)
    states = cut_lineage(maintenance.file_states(found, registry, settings.embed_signature))
    stale = states.where("state <> 'unchanged'")
    docs = read_table(spark, store, "documents")
    kept = cut_lineage((docs.limit(0) if force else docs).join(stale.select(F.col("filename").alias("source")), "source", "left_anti"))
    changed = stale.where("state <> 'deleted'").select(F.col("filename").alias("source")).join(found.withColumnRenamed("filename", "source"), "source")
    # only the files that changed are parsed; one that cannot be is not registered, so that it is tried again
    units = cut_lineage(files.load_folder(spark, folder, only=changed.select(F.col("source").alias("path")), errors=True))
    broken = cut_lineage(units.where("error is not null").select("source", "error"))
    changed = changed.join(broken, "source", "left_anti")
    units = units.where("error is null")
    chunks = chunk_units(units).join(changed, "source").withColumn("order", F.concat_ws("|", "source", F.lpad(F.coalesce(F.col("page").cast("string"), F.lit("")), 8, "0"), F.lpad(F.col("no").cast("string"), 8, "0")))
    fresh = maintenance.new_rows(chunks, kept, "content", "order").withColumn("vector", embed(F.col("content"), provider))
    vector, valid = mask_failures(F.col("vector"), F.col("media_type"))
    values = {
        "id": F.xxhash64("source", "page", "no", "content"), "parent_id": F.col("parent_no").cast("bigint"), "level": F.lit(1), "embedding": vector.cast("array<float>"), "embedding_valid": valid, "created_at": F.expr("localtimestamp()"),
    }
    wanted = [x.strip().split(" ", 1) for x in TABLES["documents"].replace("map<string,double>", "map<string;double>").split(",")]
    rows = fresh.select(*[values.get(c, F.col(c) if c in fresh.columns else F.lit(None)).cast(t.replace(";", ",")).alias(c) for c, t in wanted])
    replace_table(kept.select(*[c for c, _ in wanted]).unionByName(maintenance.with_defaults(rows)), store, "documents")
    known = registry.join(states.where("state = 'deleted'").select("filename"), "filename", "left_anti")
    merged = maintenance.upsert_registry(known, changed.select(F.col("source").alias("filename"), "file_hash"), settings.embed_signature)
    replace_table(merged.select(F.xxhash64("filename").alias("id"), "filename", "file_hash", "embed_model", F.expr("localtimestamp()").alias("processed_at")), store, "indexed_files")
    return states.join(broken.withColumnRenamed("source", "filename"), "filename", "left")


def enrich(spark: SparkSession, store: str, provider: EmbeddingProvider | None = None) -> int:
    """Adds propositions (level 0) of the chunks that have none; their number."""
    docs = read_table(spark, store, "documents")
    made = maintenance.propositions(maintenance.unenriched(docs).select("id", "content"))
    made = cut_lineage(made.withColumn("order", F.concat_ws("|", F.col("parent_id").cast("string"), F.lpad(F.col("no").cast("string"), 8, "0"))))
    about = docs.select(F.col("id").alias("parent_id"), "source", "page", "file_hash")
    rows = made.join(about, "parent_id").withColumns(
        {"id": F.xxhash64("parent_id", "no", "content"), "doc_type": F.lit("proposition"), "embedding": embed(F.col("content"), provider).cast("array<float>"), "embedding_valid": F.lit(True), "media_type": F.lit("text"), "created_at": F.expr("localtimestamp()")}
    )
    every = cut_lineage(docs.unionByName(rows.drop("no", "order"), allowMissingColumns=True).select(*docs.columns))
    replace_table(every, store, "documents")
    return made.count()


