"""Filling containers of fixed capacity: sum-of-squares online packing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.tokens import DEFAULT_RANKS, token_count
from lodeseam.session import cut_lineage

CAPACITY = 2048
#: Items that one task places one after the other; the number of shards follows the number of items.
SHARD_ITEMS = 200_000


def sum_of_squares(sizes: np.ndarray, capacity: int, merge: bool = True) -> np.ndarray:
    """A container number for each item, in the order given.

    Each item goes to the fill level (or a new container) that leaves the least sum of squares of the counts
    of partially filled containers per level. At the end the containers still open are merged (``merge``), fullest
    first, each into the fullest one that has room.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed = np.empty(len(sizes), dtype=np.int64)
    n = 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        if s >= capacity:
            placed[i] = n
            n += 1
            continue
        # change of the sum for each level h from 0 (a new container) to capacity - s (filled up)
        here, there = count[: capacity - s + 1], count[s : capacity + 1]
        change = 2 * (there - here) + 2
        change[1:][here[1:] == 0] = far
        change[0] = 2 * there[0] + 1
        if here[-1]:
            change[-1] = 1 - 2 * here[-1]
        h = int(np.argmin(change))
        if h == 0:
            b = n
            n += 1
        else:
            b = open_[h].pop()
            count[h] -= 1
        placed[i] = b
        if h + s < capacity:
            open_[h + s].append(b)
            count[h + s] += 1
    if not merge:
        return placed
    # what is still open: best fit, fullest first
    into = np.arange(n)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for h in range(capacity - 1, 0, -1):
        for b in open_[h]:
            r = next((x for x in range(h, capacity) if room[x]), None) if h <= capacity // 2 else None
            if r is None:
                room[capacity - h].append(b)
            else:
                into[b] = t = room[r].pop()
                if r - h:
                    room[r - h].append(t)
    _, dense = np.unique(into[placed], return_inverse=True)
    return dense


def pack(df: DataFrame, key: str, size: Column, capacity: int = CAPACITY) -> DataFrame:
    """``key, piece_no, n_tokens, container`` for every item; only items above ``capacity`` have several pieces.

    The whole multiples of the capacity of an oversized item fill containers of their own; its remainder is
    placed like any item. Items of size 0 (null and empty texts) take no room and have a null container.
    Repeated keys are packed as often as they occur. Items are dealt to shards by the hash of the key, one
    shard per SHARD_ITEMS items, so a task's work is bounded; containers are numbered ``shard/number``.
    """
    sized = cut_lineage(df.select(F.col(f"`{key}`").alias("key"), F.coalesce(size, F.lit(0)).cast("int").alias("size")))
    pieces = F.expr(f"transform(sequence(0, greatest(size - 1, 0) div {capacity}), i -> struct(cast(i as int) as piece_no, least(size - i * {capacity}, {capacity}) as n_tokens))")
    items = sized.select("key", F.inline(pieces))
    n = items.count()
    shards = max(1, math.ceil(n / SHARD_ITEMS))
    items = items.withColumn("shard", F.pmod(F.xxhash64("key", "piece_no"), F.lit(shards)).cast("int"))
    key_type = sized.schema["key"].dataType.simpleString()

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "piece_no"], kind="stable")
        # an order that does not depend on how the rows arrived, nor follows the keys
        order = np.argsort(pd.util.hash_pandas_object(pdf[["key", "piece_no"]], index=False).to_numpy(), kind="stable")
        pdf = pdf.iloc[order]
        some = pdf["n_tokens"].to_numpy() > 0
        box = np.full(len(pdf), -1)
        box[some] = sum_of_squares(pdf["n_tokens"].to_numpy()[some], capacity)
        shard = str(int(pdf["shard"].iloc[0]))
        return pdf[["key", "piece_no", "n_tokens"]].assign(container=[f"{shard}/{b}" if b >= 0 else None for b in box])

    out = items.groupBy("shard").applyInPandas(place, f"key {key_type}, piece_no int, n_tokens int, container string")
    return out.withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """:func:`pack` of texts measured in tokens of a public tokenizer."""
    return pack(docs, key, token_count(F.col(f"`{text}`"), ranks), capacity)


def cut_tokens(df: DataFrame, text: str, piece_no: str, capacity: int = CAPACITY, ranks: str = DEFAULT_RANKS) -> Column:
    """The text of one piece: tokens ``piece_no * capacity`` onward; bytes of a divided character stay escaped."""
    from lodeseam.llm.tokens import encoding

    @F.pandas_udf("string")
    def cut(s: pd.Series, no: pd.Series) -> pd.Series:
        enc = encoding(ranks)
        slices: Iterator = (enc.encode_ordinary(t)[k * capacity : (k + 1) * capacity] if t else [] for t, k in zip(s, no, strict=True))
        return pd.Series([enc.decode_bytes(x).decode("utf-8", errors="backslashreplace") for x in slices])

    return cut(df[text], df[piece_no])
