"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from lodeseam.streaming import gate, ingest


def test_ingest_in_steps(spark, tmp_path):
    src, index, state = (str(tmp_path / x) for x in ("src", "index", "state"))
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, t string").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest.ingest(ingest.read_documents(spark, src, schema), index, state, "id", "t").awaitTermination()
    spark.createDataFrame([(4, "b"), (5, "c"), (6, None)], "id bigint, t string").coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(ingest.read_documents(spark, src, schema), index, state, "id", "t").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(index).collect()) == [1, 2, 5, 6]


def test_gate_over_two_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))

    def run():
        s = gate.quality_gate_stream(spark.readStream.schema("session string, id bigint, score double").parquet(src))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([("s", i, 0.4) for i in range(3)], "session string, id bigint, score double").coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([("s", i, 0.6) for i in range(3, 6)] + [("t", 1, 0.6)], "session string, id bigint, score double").coalesce(1).write.mode("append").parquet(src)
    run()
    got = {(r["session"], r["id"]): r["degraded"] for r in spark.read.parquet(out).select("session", "id", "degraded", F.lit(1)).collect()}
    assert got == {**{("s", i): True for i in range(6)}, ("t", 1): False}
