"""An index over a folder that changes."""

from pyspark.sql import functions as F

from lodeseam import index, session
from lodeseam.pipeline import stream_answer
from lodeseam.settings import Settings


def sources(spark, store):
    return {r["source"].rsplit("/", 1)[-1]: r["n"] for r in index.read_table(spark, store, "documents").groupBy("source").agg(F.count("*").alias("n")).collect()}


def states(df):
    return {r["filename"].rsplit("/", 1)[-1]: r["state"] for r in df.collect()}


def test_build_refresh_enrich(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.txt").write_text("The harbour pump holds 40 bar. It is checked in spring. " * 80)
    (folder / "b.txt").write_text("The keeper writes every figure into the ledger.")
    (folder / "copy.txt").write_text("The keeper writes every figure into the ledger.")
    assert states(index.build_index(spark, str(folder), store)) == {"a.txt": "new", "b.txt": "new", "copy.txt": "new"}
    first = sources(spark, store)
    assert first["a.txt"] == 3 and first.get("b.txt", 0) + first.get("copy.txt", 0) == 1
    assert set(states(index.build_index(spark, str(folder), store)).values()) == {"unchanged"} and sources(spark, store) == first
    (folder / "a.txt").write_text("The harbour pump holds 50 bar since the last audit.")
    (folder / "copy.txt").unlink()
    (folder / "b.txt").unlink()
    assert states(index.build_index(spark, str(folder), store)) == {"a.txt": "content_changed", "copy.txt": "deleted", "b.txt": "deleted"}
    assert sources(spark, store) == {"a.txt": 1}
    docs = index.read_table(spark, store, "documents")
    row = docs.first()
    assert row["embedding_valid"] and len(row["embedding"]) == 64 and row["level"] == 1 and len(row["doc_hash"]) == 64
    assert states(index.build_index(spark, str(folder), store, settings=Settings(embed_revision="2"))) == {"a.txt": "model_changed"}
    assert index.enrich(spark, store) == 1 and index.enrich(spark, store) == 0
    docs = index.read_table(spark, store, "documents")
    assert sorted(r["level"] for r in docs.collect()) == [0, 1]
    told = "".join(stream_answer(docs.select("id", F.col("content").alias("text"), "source", "page", "level"), "what does the harbour pump hold"))
    assert "50 bar" in told and "a.txt" in told
    index.build_index(spark, str(folder), store, force=True)
    assert sources(spark, store) == {"a.txt": 1}


def test_a_broken_file_is_told_and_tried_again(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.txt").write_text("The keeper writes every figure into the ledger.")
    (folder / "b.docx").write_bytes(b"no archive")
    got = {r["filename"].rsplit("/", 1)[-1]: (r["state"], r["error"]) for r in index.build_index(spark, str(folder), store).collect()}
    assert got["a.txt"] == ("new", None) and got["b.docx"][0] == "new" and "BadZipFile" in got["b.docx"][1]
    assert states(index.build_index(spark, str(folder), store)) == {"a.txt": "unchanged", "b.docx": "new"}
    # a version that was not finished does not count
    (tmp_path / "store" / "documents" / "v000000000099").mkdir()
    assert sources(spark, store) == {"a.txt": 1}


def test_a_key_of_many_rows_is_spread_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_FLOOR", 10)
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    left = spark.range(3000).selectExpr("if(id < 2900, 1, id) as k", "id")
    hot = session.hot_keys(left, "k")
    assert hot == [1] and hot.salts[1] >= 2900 / 20
    right = spark.createDataFrame([(1, "a"), (2950, "b")], "k bigint, v string")
    got = session.salted_lookup(left, right, "k", "id", hot).groupBy("v").count().collect()
    assert {(r["v"], r["count"]) for r in got} == {("a", 2900), ("b", 1), (None, 99)}
