"""Incremental ingestion as a stream: each micro-batch inserts what the index does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodeseam.functions.text import doc_hash
from lodeseam.operators.maintenance import new_rows


def read_documents(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(stream: DataFrame, index: str, checkpoint: str, key: str, text: str) -> StreamingQuery:
    """Append the stream's new texts to the Parquet table ``index``, once per text, and stop when all is read.

    Every batch is one folder of the table, written over if a failed batch is repeated, so that a repeat adds nothing.
    """
    spark = stream.sparkSession

    def insert(batch: DataFrame, no: int) -> None:
        others = spark.read.schema("doc_hash string, batch bigint").parquet(index).where(F.col("batch") != no) if _exists(spark, index) else spark.createDataFrame([], "doc_hash string")
        fresh = new_rows(batch.select(key, text), others, text, key)
        fresh.write.mode("overwrite").parquet(f"{index}/batch={no}")

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def distinct_hashes(stream: DataFrame, text: str) -> DataFrame:
    """A stream of the texts' hashes, each once, kept in the state store."""
    return stream.select(doc_hash(F.coalesce(F.col(text), F.lit(""))).alias("doc_hash")).dropDuplicates(["doc_hash"])
