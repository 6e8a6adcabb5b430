"""The tables of an index, and creating and dropping them."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = {
    "documents": "id bigint, doc_hash string, doc_type string, source string, page int, file_hash string, parent_id bigint, level int, content string, embedding array<float>, "
    "colbert_vecs array<array<float>>, sparse_vector map<string,double>, media_path string, media_type string, embedding_valid boolean, created_at timestamp_ntz",
    "indexed_files": "id bigint, filename string, file_hash string, embed_model string, processed_at timestamp_ntz",
    "eval_results": "id bigint, query string, faithfulness double, answer_relevance double, context_recall double, overall double, evaluated_at timestamp_ntz",
    "synthetic_qa": "id bigint, chunk_id bigint, question string, answer string, created_at timestamp_ntz",
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Parquet tables, where they do not exist yet."""
    spark.sql(f"create database if not exists {database}")
    for name, ddl in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({ddl}) using parquet")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for name in TABLES:
        spark.sql(f"drop table if exists {database}.{name}")
