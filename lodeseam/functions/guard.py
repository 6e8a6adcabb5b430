"""Guardrails as predicates over texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases each guard looks for.
BLOCKLIST = ("hack", "exploit", "porn", "bomb", "kill", "murder", "terrorist", "suicide", "illegal", "meth", "cocaine")
INPUT_WORDS = ("ignore previous instructions", "bypass", "hack", "jailbreak", "system prompt", "reveal instructions", "delete database", "drop table", "password")
JAILBREAK = ("ignore previous", "act as", "pretend", "you are now", "no rules", "do anything")
OUTPUT_WORDS = ("hack", "explosive", "weapon", "illegal", "bypass", "attack")
CONTEXT = ("ignore context", "ignore previous", "use your knowledge", "override instructions", "do not follow")
SAFE_REFUSAL = "I cannot answer that question as it violates safety guidelines."


def mentions(c: Column, phrases: tuple[str, ...]) -> Column:
    """Any of the phrases, as a substring, whatever its case."""
    return reduce(lambda a, p: a | F.contains(F.lower(c), F.lit(p)), phrases, F.lit(False))


def blocked(c: Column) -> Column:
    return mentions(c, BLOCKLIST)


def output_window(c: Column) -> Column:
    """What is checked of an output: all of it, or its first and last 500 characters."""
    return F.when(F.length(c) > 1000, F.concat(F.substring(c, 1, 500), F.lit(" "), F.right(c, F.lit(500)))).otherwise(c)


def toxic(label: Column, score: Column, threshold: float) -> Column:
    """A classifier's verdict; no verdict blocks nothing."""
    return F.coalesce((label == "toxic") & (score > threshold), F.lit(False))


def verdicts(c: Column) -> list[Column]:
    """The five guards of the older pipeline: true is safe, but for jailbreak."""
    return [
        (~mentions(c, INPUT_WORDS)).alias("input_ok"),
        (F.length(c) <= 500).alias("length_ok"),
        mentions(c, JAILBREAK).alias("jailbreak"),
        (~mentions(c, CONTEXT)).alias("context_ok"),
        (~mentions(c, OUTPUT_WORDS)).alias("output_ok"),
    ]
