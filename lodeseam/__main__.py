"""python -m lodeseam FOLDER STORE: a console. A line is a question; /refresh reads changed files, /reset all files; exit leaves."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from lodeseam.functions.text import sanitise_input
from lodeseam.index import build_index, read_table
from lodeseam.pipeline import stream_answer
from lodeseam.session import build_session


def main(folder: str, store: str) -> None:
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    build_index(spark, folder, store)
    for line in sys.stdin:
        match line.strip():
            case "exit":
                return
            case "/refresh" | "/reset" as command:
                states = build_index(spark, folder, store, force=command == "/reset")
                print({r["state"]: r["count"] for r in states.groupBy("state").count().collect()})
            case "":
                continue
            case question:
                text, warnings = sanitise_input(F.lit(question))
                row = spark.range(1).select(text.alias("t"), warnings.alias("w")).first()
                for w in row["w"]:
                    print(f"[{w}]")
                docs = read_table(spark, store, "documents").select("id", F.col("content").alias("text"), "source", "page", "level")
                for part in stream_answer(docs, row["t"]):
                    print(part, end="", flush=True)
                print()


if __name__ == "__main__":
    main(*sys.argv[1:3])
