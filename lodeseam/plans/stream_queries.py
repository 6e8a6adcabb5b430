"""Queries that run a stream over all there is and return what it wrote, with the SQL of the same in batch."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from lodeseam.session import ensure_checkpoint_dir, table
from lodeseam.streaming import gate, ingest


def _folder(spark) -> str:
    """A fresh folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def ingest_stream(spark, d):
    schema = table(spark, d, "documents").schema
    at = _folder(spark)
    stream = ingest.read_documents(spark, os.path.join(d, "documents.parquet*"), schema)
    ingest.ingest(stream, f"{at}/index", f"{at}/state", "doc_id", "text").awaitTermination()
    return spark.read.parquet(f"{at}/index").select("doc_hash")


def quality_gate_stream(spark, d):
    schema = table(spark, d, "events").schema
    at = _folder(spark)
    events = spark.readStream.schema(schema).parquet(os.path.join(d, "events.parquet*"))
    scores = events.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("id"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))
    out = gate.quality_gate_stream(scores)
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


QUERIES = {"ingest_stream": ingest_stream, "quality_gate_stream": quality_gate_stream}
SQL = {
    "ingest_stream": "select distinct sha256(coalesce(text, '')) doc_hash from documents",
    "quality_gate_stream": "with m as (select user_id::varchar as \"session\", event_id id, round(avg(least(1.0::double, value / 100)) over (partition by user_id order by event_id rows between 9 preceding and current row), 9) mean from events) "
    "select \"session\", id, mean, coalesce(last_value(case when mean < 0.5 then true when mean > 0.7 then false end ignore nulls) over (partition by \"session\" order by id rows between unbounded preceding and current row), false) degraded from m",
}
