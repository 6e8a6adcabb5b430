"""Conversations as rows ``conv_id, turn, role, content``: tails, memory, budgets, prompts, other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions.text import token_length

TRUNCATED = "\n[...truncated for length...]"


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of every conversation; limited per task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_r") <= n).drop("_r")


def evicted(df: DataFrame, keep: int = 8, chars: int = 300) -> DataFrame:
    """All but the last ``keep`` messages, as the memory sees them: ``Role: beginning``."""
    r = df.withColumn("_r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_r") > keep)
    return r.select("conv_id", "turn", F.concat(F.initcap("role"), F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, chars)).alias("line"))


def truncate(df: DataFrame, most: int = 12_000) -> DataFrame:
    """``df`` with the last user message of conversations over ``most`` tokens cut (four are added per message; ten to spare)."""
    c = F.coalesce("content", F.lit(""))
    per = df.groupBy("conv_id").agg(F.sum(token_length(c) + 4).alias("_n"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("_last"))
    j = df.join(per, "conv_id")
    allowed = F.greatest(F.lit(1), token_length(c) - (F.col("_n") - most) - 10).cast("int")
    cut = (F.col("_n") > most) & (F.col("turn") == F.col("_last"))
    return j.withColumn("content", F.when(cut, F.concat(F.substring(c, F.lit(1), allowed * 4), F.lit(TRUNCATED))).otherwise(F.col("content"))).drop("_n", "_last")


def fold_system(df: DataFrame) -> DataFrame:
    """Messages for models without a system role: system texts go before the next user message, or become one at the end; others are ``model``."""
    users_after = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0))
    d = df.withColumn("_g", users_after)
    rules = d.where("role = 'system'").groupBy("conv_id", "_g").agg(F.max("turn").alias("_t"), F.array_join(F.sort_array(F.collect_list(F.struct("turn", "content"))).getField("content"), "\n\n").alias("_rules"))
    block = F.concat(F.lit("[SYSTEM INSTRUCTIONS]\n"), F.col("_rules"), F.lit("\n[END SYSTEM INSTRUCTIONS]"))
    last = rules.where("_g = 0").select("conv_id", F.col("_t").alias("turn"), F.lit("user").alias("role"), block.alias("content"))
    others = d.where("role <> 'system'").join(rules.select("conv_id", "_g", "_rules"), ["conv_id", "_g"], "left")
    mine = others.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "user").otherwise("model").alias("role"),
        F.when((F.col("role") == "user") & F.col("_rules").isNotNull(), F.concat(block, F.lit("\n\n"), F.col("content"))).otherwise(F.col("content")).alias("content"),
    )
    return mine.unionByName(last)


def document_block(no: Column, source: Column, text: Column, chars: int | None = None) -> Column:
    body = F.substring(text, 1, chars) if chars else text
    return F.concat(F.lit('<DOCUMENT index="'), no.cast("string"), F.lit('" source="'), source, F.lit('">'), body, F.lit("</DOCUMENT>"))


def answer_prompt(question: Column, context: Column, sources: Column, rule: Column, conflict: Column) -> Column:
    """Context, sources and question under numbered instructions; a conflict comes first."""
    first = F.when(conflict != "", F.concat(F.lit("Conflicting information: "), conflict, F.lit("\n\n"))).otherwise("")
    return F.concat(
        first, F.lit("Context:\n"), context, F.lit("\n\nSources referenced:\n"), sources, F.lit("\n\nQuestion: "), question, F.lit("\n\nInstructions:\n1. Use the context only.\n2. "), rule, F.lit("\n3. Name the source of every claim.\n")
    )
