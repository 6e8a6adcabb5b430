"""Chunking as folds over arrays: every row is cut where it lies, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.text import sentences, strip, token_length, word_count

PARENT_TOKENS, CHILD_TOKENS, OVERLAP = 1500, 512, 100
TABLE_TOKENS, TABLE_ROWS = 400, 15


def _is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_heading(line: Column) -> Column:
    """Capitals (over two characters, at most eight words), or a short line with a capital, no figures and no end mark."""
    first = F.substring(line, 1, 1)
    capitals = _is_upper(line) & (F.length(line) > 2) & (word_count(line) <= 8)
    title = (word_count(line) <= 5) & _is_upper(first) & ~line.rlike(r"[.,:;?!]$") & ~line.rlike(r"\d")
    return capitals | title


def is_short_heading(line: Column) -> Column:
    """The older rule: capitals, or at most four words with a capital first."""
    return _is_upper(line) | ((word_count(line) <= 4) & _is_upper(F.substring(line, 1, 1)))


def sections(c: Column, heading=is_heading) -> Column:
    """array(struct(heading, body)): lines under their heading, ``General`` before the first; a heading without a body is dropped."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    flagged = F.transform(lines, lambda x: F.struct(x.alias("line"), heading(x).alias("is_heading")))
    none = F.array().cast("array<struct<heading:string,body:string>>")
    start = F.struct(F.lit("General").alias("now"), F.lit(None).cast("string").alias("body"), none.alias("done"))

    def close(acc: Column) -> Column:
        return F.when(acc["body"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["now"].alias("heading"), acc["body"].alias("body"))))

    def step(acc: Column, x: Column) -> Column:
        head = F.struct(x["line"].alias("now"), F.lit(None).cast("string").alias("body"), close(acc).alias("done"))
        body = F.struct(acc["now"].alias("now"), F.concat_ws(" ", acc["body"], x["line"]).alias("body"), acc["done"].alias("done"))
        return F.when(x["is_heading"], head).otherwise(body)

    return F.aggregate(flagged, start, step, close)


def pack_parents(c: Column, most: int = PARENT_TOKENS) -> Column:
    """Sentences packed greedily up to ``most`` tokens; a longer sentence is a parent of its own, never cut."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def close(acc: Column) -> Column:
        t = strip(acc["now"])
        return F.when(t != "", F.array_append(acc["done"], t)).otherwise(acc["done"])

    def step(acc: Column, s: Column) -> Column:
        longer = strip(F.concat(acc["now"], F.lit(" "), s))
        return F.when(token_length(longer) <= most, F.struct(longer.alias("now"), acc["done"].alias("done"))).otherwise(F.struct(s.alias("now"), close(acc).alias("done")))

    return F.aggregate(sentences(c), start, step, close)


def windows(c: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each ``overlap`` into the one before; without progress they don't overlap."""
    step = size - overlap if size > overlap else size
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(size)))


def parent_child(df: DataFrame, text: str, parent_tokens: int = PARENT_TOKENS, child_tokens: int = CHILD_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """``df`` plus ``child_id, parent_no, parent, child``: ids count from 0 within a text, blank children have none. Null and empty texts have no rows."""
    parents = pack_parents(F.col(text), parent_tokens)
    cut = F.transform(parents, lambda p, i: F.transform(windows(p, child_tokens * 4, overlap), lambda w: F.struct(i.alias("parent_no"), p.alias("parent"), strip(w).alias("child"))))
    every = F.filter(F.flatten(cut), lambda x: x["child"] != "")
    return df.select("*", F.posexplode(every).alias("child_id", "_c")).select("*", "_c.*").drop("_c")


def flat_chunks(c: Column, size: int = 800, overlap: int = 150) -> Column:
    """Sentences up to ``size`` characters; a chunk begins with the last ``overlap`` characters of the one before."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) <= size
        longer = F.struct(F.concat(acc["now"], F.lit(" "), s).alias("now"), acc["done"].alias("done"))
        fresh = F.struct(F.concat(F.right(acc["now"], F.lit(overlap)), F.lit(" "), s).alias("now"), F.array_append(acc["done"], strip(acc["now"])).alias("done"))
        return F.when(fits, longer).otherwise(fresh)

    return F.aggregate(sentences(c), start, step, lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], strip(acc["now"]))).otherwise(acc["done"]))


def pack_parents_by_chars(c: Column, size: int = 1500) -> Column:
    """The older packing, by characters and without a check for empty parents."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) <= size
        longer = F.struct(F.concat(acc["now"], F.lit(" "), s).alias("now"), acc["done"].alias("done"))
        return F.when(fits, longer).otherwise(F.struct(s.alias("now"), F.array_append(acc["done"], strip(acc["now"])).alias("done")))

    return F.aggregate(sentences(c), start, step, lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], strip(acc["now"]))).otherwise(acc["done"]))


def table_chunks(c: Column, atomic_tokens: int = TABLE_TOKENS, rows: int = TABLE_ROWS) -> Column:
    """array(struct(text, header)): a small table whole, a larger one in groups of rows under its header.

    The separator line has a cell for every piece between bars, the empty ones at the ends included. A table
    without rows, or a blank one, is one chunk.
    """
    lines = F.filter(F.split(strip(c), r"\r\n|\n|\r"), lambda x: strip(x) != "")
    header = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    first = F.when(F.coalesce(F.get(lines, F.lit(1)), F.lit("")).rlike(r"^\|[\s\-|]+\|$"), 3).otherwise(2)
    n = F.greatest(F.size(lines) - first + 1, F.lit(0))
    data = F.slice(lines, first, F.greatest(n, F.lit(1)))
    separator = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.split(header, r"\|"))))
    group = lambda i: F.concat_ws("\n", header, separator, F.array_join(F.slice(data, i * rows + 1, F.lit(rows)), "\n"))
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / rows).cast("int") - 1, F.lit(0))), lambda i: F.struct(group(i).alias("text"), header.alias("header")))
    whole = F.array(F.struct(c.alias("text"), header.alias("header")))
    return F.when((token_length(c) <= atomic_tokens) | (n == 0), whole).otherwise(many)
