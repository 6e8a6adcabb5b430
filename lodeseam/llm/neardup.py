"""Near-duplicate texts by covering locality-sensitive hashing.

A text's sketch is a row of minimum hashes of its word shingles, cut into parts of D symbols. In each part,
every nonzero vector v of R + 1 bits gives a mask: position i is kept if the bits of v and of i's own vector
have an odd number of ones in common. Any R positions have a mask that drops them all, so two sketches that
differ in at most R symbols of a part agree on all symbols that some mask keeps; over all parts, two sketches
that differ in fewer than PARTS * (R + 1) symbols are certain to meet. Met pairs are verified on all shingles.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.graph import components
from lodeseam.session import cut_lineage

PARTS, D, R = 14, 11, 2
SYMBOLS = PARTS * D
#: Keys that one task looks through at a time.
BUCKET_KEYS = 1_500_000
#: A key of more rows than this, whatever their share, is looked through in pairs of blocks of about this size, and
#: only pairs go on whose sketches agree in so many symbols as a similar pair has but for SIGMAS standard deviations.
BLOCK, SIGMAS = 2000, 6
#: Keys with more than this share of all rows never enter one task; there are at most TABLES / HOT_SHARE of them.
HOT_SHARE = 0.01

_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: For each mask the positions it keeps.
MASKS = [np.flatnonzero([bin((1 + i % (2 ** (R + 1) - 1)) & v).count("1") % 2 for i in range(D)]) for v in range(1, 2 ** (R + 1))]
TABLES = PARTS * len(MASKS)


def _shingles(words: list[str], width: int, cache: dict[str, int]) -> np.ndarray:
    """The distinct 64-bit hashes of runs of ``width`` words."""
    import xxhash

    if len(cache) > 1_000_000:
        cache.clear()
    for w in words:
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w)
    h = np.array([cache[w] for w in words], dtype=np.uint64)
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    s = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        s = (s ^ h[i : i + n]) * _MIX[i % len(_MIX)]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _symbols(s: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, lo : lo + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def table_keys(symbols: np.ndarray) -> np.ndarray:
    """One 64-bit key per table for each row of symbols."""
    s = symbols.astype(np.uint64).reshape(len(symbols), PARTS, D)
    out = np.empty((len(symbols), PARTS, len(MASKS)), dtype=np.uint64)
    for k, kept in enumerate(MASKS):
        key = np.broadcast_to(np.arange(PARTS, dtype=np.uint64) * np.uint64(64) + np.uint64(k + 1), s.shape[:2]) * _MIX[0]
        for i in kept:
            key = (key ^ s[:, :, i]) * _MIX[1]
            key = key ^ (key >> np.uint64(31))
        out[:, :, k] = key
    return out.reshape(len(symbols), TABLES).view(np.int64)


def sketch(df: DataFrame, key: str, text: str, width: int, least_words: int) -> DataFrame:
    """``id, d, e, shingles, symbols`` of texts with at least ``least_words`` words (and one shingle); d, e tell word sequences apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        cache: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["t"], strict=True):
                words = _WORD.findall(t.lower()) if t else []
                if len(words) < max(least_words, width):
                    continue
                digest = xxhash.xxh128_digest(" ".join(words))
                s = _shingles(words, width, cache)
                rows.append((i, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), s.astype("<u8").tobytes(), _symbols(s).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "d", "e", "shingles", "symbols"])

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t")).where("id is not null and t is not null")
    return rows.mapInPandas(run, "id bigint, d bigint, e bigint, shingles binary, symbols binary")


def _within(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs a < b of ids that share a key, members (key, id) of the keys with more than BLOCK ids)."""
    order = np.argsort(key, kind="stable")
    key, ids = key[order], ids[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    out = []
    for g in np.unique(size[(size > 1) & (size <= BLOCK)]):
        at = edge[:-1][size == g]
        i, j = np.triu_indices(g, 1)
        step = max(1, 2_000_000 // len(i))
        for lo in range(0, len(at), step):
            a, b = (ids[(at[lo : lo + step, None] + x).ravel()] for x in (i, j))
            out.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), dtype=np.int64)
    many = np.repeat(size > BLOCK, size)
    return pairs[pairs[:, 0] < pairs[:, 1]], np.stack([key[many], ids[many]], axis=1)


def candidates(reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """``a, b``: distinct pairs of ``reps`` (``id, symbols``) that share the key of some table.

    Keys of up to BLOCK rows are paired where they meet. Larger ones go on as members only, and are paired block by
    block: a task holds two blocks, and returns the pairs whose whole sketches agree as similar ones do.
    """
    keys_of = lambda pdf: table_keys(np.frombuffer(b"".join(pdf["symbols"]), dtype="<u4").reshape(-1, SYMBOLS))

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                k, c = np.unique(keys_of(pdf), return_counts=True)
                some = c > max(32, HOT_SHARE * len(pdf))
                yield pd.DataFrame({"k": k[some], "c": c[some]})

    # at most TABLES / HOT_SHARE keys can hold such a share of all batches
    hot: list[int] = []
    if n > BLOCK:
        counted = reps.select("symbols").mapInPandas(frequent, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c"))
        hot = [r["k"] for r in counted.where(F.col("c") > max(BLOCK, HOT_SHARE * n / 2)).select("k").collect()]
    hot_list = np.array(sorted(hot), dtype=np.int64)
    buckets = max(1, math.ceil(n * TABLES / BUCKET_KEYS))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            key = keys_of(pdf).ravel()
            ids = np.repeat(pdf["id"].to_numpy(), TABLES)
            # bucket -1: members of the most frequent keys, which pass by
            bucket = ((key.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            bucket[np.isin(key, hot_list)] = -1
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(-1, buckets + 1))
            some = [b for b in range(-1, buckets) if edge[b + 2] > edge[b + 1]]
            spans = [order[edge[b + 1] : edge[b + 2]] for b in some]
            yield pd.DataFrame({"bucket": some, "k": [key[x].tobytes() for x in spans], "i": [ids[x].tobytes() for x in spans]})

    def rows_of(pairs: np.ndarray, members: np.ndarray) -> pd.DataFrame:
        both = np.concatenate([pairs, members])
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "pair": np.arange(len(both)) < len(pairs)})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        k, i = (np.frombuffer(b"".join(pdf[c]), dtype=np.int64) for c in ("k", "i"))
        return rows_of(*_within(k, i))

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k, i = (np.frombuffer(b"".join(pdf[c]), dtype=np.int64) for c in ("k", "i"))
            yield rows_of(np.empty((0, 2), dtype=np.int64), np.stack([k, i], axis=1))

    dealt = reps.select("id", "symbols").mapInPandas(deal, "bucket bigint, k binary, i binary")
    kind = "a bigint, b bigint, pair boolean"
    found = dealt.where("bucket >= 0").groupBy("bucket").applyInPandas(meet, kind)
    if hot:
        found = found.unionByName(dealt.where("bucket < 0").mapInPandas(passing, kind))
    found = cut_lineage(found)
    pairs = found.where("pair").select("a", "b")
    members = found.where("not pair").select(F.col("a").alias("k"), F.col("b").alias("id")).distinct()
    if members.isEmpty():
        return pairs.distinct()
    blocks = members.groupBy("k").agg(F.ceil(F.count("*") * 1.5 / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = members.join(blocks, "k").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("k", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id")
    # one byte of each symbol is enough to compare sketches by: it can only make them more alike
    small = reps.join(members.select("id").distinct(), "id", "left_semi").select("id", _bytes("symbols").alias("s"))
    need = max(0.0, threshold * SYMBOLS - SIGMAS * math.sqrt(threshold * (1 - threshold) * SYMBOLS))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ids = pdf["own"].to_numpy(), pdf["id"].to_numpy()
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        s = np.frombuffer(b"".join(pdf["s"]), dtype=np.uint8).reshape(-1, SYMBOLS)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        out = []
        for lo in range(0, len(left), 256):
            mine = left[lo : lo + 256]
            alike = np.zeros((len(mine), len(right)), dtype=np.uint8)
            for j in range(SYMBOLS):
                alike += s[mine, j][:, None] == s[right, j][None, :]
            r, c = np.nonzero(alike >= need)
            out.append(np.stack([ids[mine[r]], ids[right[c]]], axis=1))
        both = np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
        both = both[both[:, 0] != both[:, 1]] if x != y else both[both[:, 0] < both[:, 1]]
        return pd.DataFrame({"a": both.min(axis=1), "b": both.max(axis=1)}) if len(both) else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    more = spread.join(small, "id").groupBy("k", "x", "y").applyInPandas(across, "a bigint, b bigint")
    return pairs.unionByName(more).distinct()


def _bytes(symbols: str) -> Column:
    @F.pandas_udf("binary")
    def low(s: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, dtype=np.uint8)[::4].tobytes() for x in s], dtype="object")

    return low(symbols)


def _jaccard(x: str, y: str) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            a, b = np.frombuffer(p, dtype="<u8"), np.frombuffer(q, dtype="<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / (len(a) + len(b) - both))
        return pd.Series(out, dtype="float64")

    return of(x, y)


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts whose sets of ``width``-word shingles have a similarity of ``threshold`` or more.

    ``members``: ``id, rep`` for every text looked at; texts of equal words share ``rep``, the smallest id.
    ``links``: ``a, b, similarity`` between different texts' representatives, a < b. Words are maximal runs of
    letters and digits, lower-cased. Null texts, null keys and texts of fewer than ``least_words`` words (or
    than ``width``) are not looked at. Keys must be unique. Whole texts count, of any length. Candidates come
    from the covering tables only; a pair above the threshold is missed only if its sketches differ in more
    than PARTS * (R + 1) - 1 of SYMBOLS symbols, and then seldom. Copies never enter the tables; keys that more than
    BLOCK texts share are looked through in bounded blocks, and only pairs with sketches alike leave them.
    """
    base = cut_lineage(sketch(df, key, text, width, least_words))
    copies = base.groupBy("d", "e").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copy = cut_lineage(base.select("id", "d", "e").join(copies, ["d", "e"]).where("id <> rep").select("id", "rep"))
    members = base.select("id").join(copy, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    reps = base.join(copy.select("id"), "id", "left_anti")
    n = base.count() - copy.count()
    pairs = cut_lineage(candidates(reps, n, threshold))
    need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = base.select("id", "shingles").join(need, "id", "left_semi")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    links = both.select("a", "b", _jaccard("x", "y").alias("similarity")).where(F.col("similarity") >= threshold)
    return members, links


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, rep, group_id, n_links``: per text its class of equal words, its group, and how many different texts its class is linked to."""
    links = cut_lineage(links)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    per = components(links).join(ends.groupBy("rep").agg(F.count("*").alias("n_links")).withColumnRenamed("rep", "id"), "id")
    out = members.join(per.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("id", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a, id_b``: every pair of ids whose texts are linked or equal, for results that ask for the pairs themselves."""
    same = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    many = members.join(same, "rep", "left_semi")
    equal = many.select("rep", F.col("id").alias("x")).join(many.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    a, b = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    linked = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    return equal.unionByName(linked).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
