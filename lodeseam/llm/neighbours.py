"""The most similar vectors for every vector: a forest of random-projection trees.

The planes of the upper levels are fitted on a bounded sample; all rows are routed to one cell a tree. Each row
that asks walks all trees through one shared priority queue: the node most likely to hold a vector at the wanted
cosine is taken next, whatever tree it is of, its children are pushed or, if it is a cell, the cell is searched.
The walk ends when a miss is unlikely, so that recall does not depend on the depth. Cells are searched on vectors of
8-bit numbers with the bound of their rounding; every candidate that the bound leaves is ranked by its exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.session import cut_lineage

#: Trees of the forest.
TREES = 4
#: How likely the cells searched from one side may be to miss a vector at the wanted cosine; if all rows ask, both sides search.
MISS = 0.05
#: Levels whose planes are each node's own; below, the nodes of a level share one direction, each with its own offset.
OWN_LEVELS = 12
#: Levels of a tree that are projected for every row at once; below, only the nodes that the walk reaches.
DENSE_LEVELS = 8
#: The trees are split until a cell holds about so many of all rows, and to this depth at least.
CELL_ROWS, LEAST_DEPTH = 6000, 2
#: About so many rows are sampled to fit the planes; all rows are indexed and searched.
FIT_ROWS = 20_000
#: A cell with more rows than this is searched by several tasks, each with a part of the indexed rows.
BLOCK_ROWS = 16384


class Forest:
    """Random-projection trees of equal depth: planes between two random rows of the sample, at its median."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.depth, self.trees, self.cells = depth, trees, 1 << depth
        self.own = min(depth, OWN_LEVELS)
        # node i has children 2i and 2i+1, 1 is the root; the shared directions of the deeper levels come last
        self.normal = np.zeros((trees, (1 << self.own) + depth - self.own, d), dtype=np.float32)
        self.offset = np.zeros((trees, self.cells), dtype=np.float32)
        for t in range(trees):
            members = {1: np.arange(len(sample))}
            shared, middle = None, 0.0
            for node in range(1, self.cells):
                level = node.bit_length() - 1
                rows = members.pop(node, np.empty(0, dtype=int))
                if level >= self.own:
                    if node == 1 << level:
                        shared = rng.standard_normal(d)
                        shared /= np.linalg.norm(shared)
                        self.normal[t, (1 << self.own) + level - self.own] = shared
                        middle = float(np.median(sample @ shared)) if len(sample) else 0.0
                    w = shared
                else:
                    w = rng.standard_normal(d)
                    if len(rows) > 1:
                        a, b = sample[rng.choice(rows, 2, replace=False)]
                        if np.abs(a - b).sum() > 1e-6:
                            w = a - b
                    w = w / np.linalg.norm(w)
                    self.normal[t, node] = w
                p = sample[rows] @ w
                # too few rows tell nothing of the middle
                m = float(np.median(p)) if len(rows) >= 4 else middle
                self.offset[t, node] = m
                members[2 * node], members[2 * node + 1] = rows[p < m], rows[p >= m]

    def _plane(self, node: np.ndarray) -> np.ndarray:
        level = np.frexp(node.astype(np.float64))[1] - 1
        return np.where(level < self.own, node, (1 << self.own) + level - self.own)

    def home(self, x: np.ndarray) -> np.ndarray:
        """Own cell of every row in every tree, as tree * cells + cell."""
        node = np.ones((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            for _ in range(self.depth):
                at = node[:, t]
                node[:, t] = 2 * at + (np.einsum("ij,ij->i", x, self.normal[t, self._plane(at)]) >= self.offset[t, at])
        return node - self.cells + np.arange(self.trees) * self.cells

    def walk(self, x: np.ndarray, cosine: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells): for each row the cells taken from its queue over the nodes of all trees, likeliest first.

        A node's priority is the probability that a vector at ``cosine`` to the row, in a random direction, lies in it. A row is done when all cells
        taken miss such a vector with a probability of at most ``miss``, or when its queue is empty.
        """
        n, spread = len(x), (1 - cosine * cosine) / max(1, x.shape[1] - 1)
        dense = min(self.own, DENSE_LEVELS)
        near = np.stack([x @ self.normal[t, : 1 << dense].T for t in range(self.trees)], axis=1)
        ids, size = np.arange(n), np.full(n, self.trees)
        # the queues: one row each, of probability, tree and node
        prio, tree, node = np.ones((n, self.trees)), np.tile(np.arange(self.trees), (n, 1)), np.ones((n, self.trees), dtype=np.int64)
        missed = np.ones((n, self.trees))
        rows, cells = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        while len(ids):
            at = np.arange(len(ids))
            best = prio.argmax(axis=1)
            p, t, v = prio[at, best], tree[at, best], node[at, best]
            leaf = v >= self.cells
            some = np.flatnonzero(leaf & (p > 0))
            rows.append(ids[some])
            cells.append(v[some] - self.cells + t[some] * self.cells)
            missed[some, t[some]] = np.maximum(0, missed[some, t[some]] - p[some])
            prio[leaf, best[leaf]] = -1
            inner = np.flatnonzero(~leaf)
            if len(inner):
                ti, vi = t[inner], v[inner]
                s = np.empty(len(inner))
                high = vi < 1 << dense
                s[high] = near[inner[high], ti[high], vi[high]]
                low = ~high
                s[low] = np.einsum("ij,ij->i", x[ids[inner[low]]], self.normal[ti[low], self._plane(vi[low])])
                z = np.clip((cosine * s - self.offset[ti, vi]) / np.sqrt(np.maximum(spread * (1 - s * s), 1e-12)), -8, 8)
                right = 1 / (1 + np.exp(-1.5976 * z - 0.07056 * z**3))  # the normal distribution to 0.0002
                if (full := int(size[inner].max())) >= prio.shape[1]:
                    wide = ((0, 0), (0, max(16, full)))
                    prio, tree, node = (np.pad(q, wide, constant_values=c) for q, c in ((prio, -1), (tree, 0), (node, 1)))
                slot, to = size[inner], best[inner]
                prio[inner, to], node[inner, to] = p[inner] * (1 - right), 2 * vi
                prio[inner, slot], node[inner, slot], tree[inner, slot] = p[inner] * right, 2 * vi + 1, ti
                size[inner] += 1
            going = (missed.prod(axis=1) > miss) & (p > 0)
            if not going.all():
                ids, size, prio, tree, node, missed, near = (q[going] for q in (ids, size, prio, tree, node, missed, near))
        return np.concatenate(rows), np.concatenate(cells)


def usual_cosine(sample: np.ndarray, n: int, k: int) -> float:
    """The cosine at which a row has twice ``k`` of ``n`` others (so that rows with fewer near them are served, too), by the spread of cosines in the sample, as if they were normal."""
    some = sample[:: max(1, len(sample) // 500)]
    c = (some @ sample.T).ravel()
    c = c[c < 0.999999]
    if len(c) < 2 or n <= 2 * k:
        return 0.0
    return float(np.clip(c.mean() + c.std() * NormalDist().inv_cdf(1 - 2 * k / n), 0.0, 0.999))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def small_numbers(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit numbers, scale, length of the rounding error) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale.astype(np.float32), np.linalg.norm(unit - q * scale.astype(np.float32)[:, None], axis=1).astype(np.float32)


def usable(df: DataFrame, vector: str, dim: int, valid: str | None = None) -> DataFrame:
    """Rows whose vector has exactly ``dim`` finite numbers, not all zero (and is not marked invalid)."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)
    return df.where(ok & F.col(f"`{valid}`")) if valid else df.where(ok)


def _cosines(x: Column, y: Column) -> Column:
    """Exact cosines of two array columns, to 9 digits."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        a, b = (_unit(np.stack(z.to_numpy()).astype(np.float64)) for z in (x, y))
        return pd.Series(np.round(np.einsum("ij,ij->i", a, b), 9))

    return of(x, y)


def nearest(df: DataFrame, key: str, vector: str, dim: int = 64, k: int = 5, least: float = -1.0, trees: int = TREES, miss: float | None = None, asks: Column | None = None) -> DataFrame:
    """``key, neighbour, cosine``: of every row the ``k`` others of highest cosine, ties by smaller key.

    ``df`` must hold usable vectors (see :func:`usable`) and unique keys. Only cosines of at least ``least`` are
    returned. ``asks`` restricts the rows that are asked about, never those searched. ``miss`` is the probability at which a row may miss a
    vector at the cosine ``least`` or, if that is not positive, at the cosine of the k-th nearest as the sample
    tells it; by default ``MISS``, or its square if not all rows ask. Cosines are rounded to 9 digits. Rows with
    equal vectors are searched as one and are each other's nearest, so a third of all rows may share a vector.
    Cells are searched in blocks, each against its whole cell. An empty table, or a single row, gives no rows.
    Approximate: a pair is missed if none of the searched cells of either row holds the other; recall is measured in the tests and the README.
    """
    v = F.col(f"`{vector}`").cast("array<float>")
    ask = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    rows = cut_lineage(df.select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v"), ask.alias("ask")))
    rows = rows.withColumns({"d": F.xxhash64("v"), "e": F.hash("v")})
    # equal vectors: one stands for all; the k + 1 smallest keys suffice as neighbours of anything
    classes = rows.groupBy("d", "e").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    copies = cut_lineage(classes.where("n > 1").select("d", "e", "n", "rep"))
    n_copies = copies.agg(F.coalesce(F.sum("n") - F.count("*"), F.lit(0))).first()[0]
    n = rows.count() - n_copies
    if n == 0:
        return df.sparkSession.createDataFrame([], "id long, neighbour long, cosine double").withColumnRenamed("id", key)
    members, reps = None, rows.select("id", "v", "ask")
    if n_copies:
        of = cut_lineage(rows.select("id", "d", "e").join(copies.select("d", "e", "rep"), ["d", "e"]).select("id", "rep"))
        # the first k + 1 of each class; the group limit keeps no more per task before the shuffle
        ranked = of.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("rn") <= k + 1)
        first = ranked.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("first"))
        members = (of, first)
        reps = reps.join(of, "id", "left").where("rep is null or rep = id").select("id", "v", (F.col("ask") | F.col("rep").isNotNull()).alias("ask"))
    depth = max(LEAST_DEPTH, math.ceil(math.log2(n / CELL_ROWS)))
    # a sample by the hash of the key: the same in every run
    share = min(1.0, FIT_ROWS / n)
    chosen = reps.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < math.ceil(share * 1_000_000_000)).select("id", "v").toPandas().sort_values("id")
    sample = _unit(np.stack(chosen["v"].to_numpy()).astype(np.float64) if len(chosen) else np.empty((0, dim)))
    forest = Forest(sample, depth, trees)
    # a cell whose share of the sample promises more than BLOCK_ROWS rows is indexed in parts
    homes = [forest.home(sample[lo : lo + 2048].astype(np.float32)).ravel() for lo in range(0, len(sample), 2048)]
    held = np.bincount(np.concatenate([*homes, np.empty(0, dtype=np.int64)]), minlength=forest.trees * forest.cells)
    parts = np.maximum(1, np.ceil(held * (n / max(1, len(sample))) / BLOCK_ROWS)).astype(np.int64)
    cosine = least if least > 0 else usual_cosine(sample, n, k)
    if miss is None:
        miss = MISS if asks is None else MISS * MISS  # one side alone has to find what both would

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            ids, asked = pdf["id"].to_numpy(), pdf["ask"].to_numpy(dtype=bool)
            unit = _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
            q, scale, error = small_numbers(unit)
            unit = unit.astype(np.float32)
            far, more = [], []
            for lo in range(0, len(ids), 1024):
                mine = lo + np.flatnonzero(asked[lo : lo + 1024])
                r, c = forest.walk(unit[mine], cosine, miss)
                far.append(mine[r])
                more.append(c)
            own = forest.home(unit)
            # bit 1: indexed here; bit 2: asks here
            row = np.concatenate([np.repeat(np.arange(len(ids)), own.shape[1]), *far])
            cell = np.concatenate([own.ravel(), *more])
            flag = np.where(np.arange(len(row)) < own.size, 1, 2)
            # asks in every part of its cells, is indexed in one part of its own
            times = np.where(flag == 2, parts[cell], 1)
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, cell, flag = (np.repeat(z, times) for z in (row, cell, flag))
            index = flag == 1
            part[index] = (ids[row[index]] * 0x9E3779B1 >> 13) % parts[cell[index]]
            order = np.lexsort((row, part, cell))
            row, cell, part, flag = (z[order] for z in (row, cell, part, flag))
            # a row that asks where it is indexed is sent once
            same = np.r_[False, (row[1:] == row[:-1]) & (cell[1:] == cell[:-1]) & (part[1:] == part[:-1])]
            flag[:-1][same[1:]] = 3
            row, cell, part, flag = (z[~same] for z in (row, cell, part, flag))
            edge = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), True])
            spans = list(zip(edge[:-1], edge[1:], strict=True))
            packed = {"ids": ids[row], "q": q[row], "scale": scale[row], "error": error[row], "flag": flag.astype(np.uint8)}
            yield pd.DataFrame({"cell": cell[edge[:-1]], "part": part[edge[:-1]]} | {c: [a[lo:hi].tobytes() for lo, hi in spans] for c, a in packed.items()})

    routed = reps.mapInPandas(route, "cell long, part long, ids binary, q binary, scale binary, error binary, flag binary")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, scale, error, flag = (np.frombuffer(b"".join(pdf[c]), dtype=t) for c, t in (("ids", "<i8"), ("scale", "<f4"), ("error", "<f4"), ("flag", "u1")))
        x = np.frombuffer(b"".join(pdf["q"]), dtype=np.int8).reshape(-1, dim).astype(np.float32) * scale[:, None]
        at, asked = np.flatnonzero(flag & 1), np.flatnonzero(flag & 2)
        place = np.full(len(ids), -1)
        place[at] = np.arange(len(at))
        # how far the rounding can move a cosine, and single precision
        slack = 2 * float(error.max()) + float(error.max()) ** 2 + 1e-5
        found = []
        indexed = np.ascontiguousarray(x[at].T)
        for lo in range(0, len(asked) if len(at) else 0, 512):
            block = asked[lo : lo + 512]
            s = x[block] @ indexed
            mine = place[block]
            s[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -2
            bar = np.full(len(s), max(least, -1.5) - slack, dtype=np.float32)
            many = np.flatnonzero((s >= bar[0]).sum(axis=1) > k)
            if len(many):
                bar[many] = np.maximum(bar[many], np.partition(s[many], len(at) - k, axis=1)[:, len(at) - k] - 2 * slack)
            r, c = np.nonzero(s >= bar[:, None])
            found.append(pd.DataFrame({"id": ids[block[r]], "neighbour": ids[at[c]], "near": s[r, c], "slack": np.float32(slack)}))
        return pd.concat(found) if found else pd.DataFrame({"id": [], "neighbour": [], "near": [], "slack": []})

    found = routed.groupBy("cell", "part").applyInPandas(search, "id long, neighbour long, near float, slack float")
    # over all cells: what may still be among the k nearest, once each
    per = found.groupBy("id", "neighbour").agg(F.max("near").alias("near"), F.max("slack").alias("slack")).groupBy("id")
    per = per.agg(F.max("slack").alias("slack"), F.sort_array(F.collect_list(F.struct("near", "neighbour")), False).alias("b"))
    bar = F.coalesce(F.get("b", F.lit(k - 1))["near"] - 2 * F.col("slack"), F.lit(-3.0))
    pairs = cut_lineage(per.withColumn("bar", bar).withColumn("b", F.filter("b", lambda s: s["near"] >= F.col("bar"))).select("id", F.inline("b")).select("id", "neighbour"))
    # exact cosines; only the vectors that are still needed are joined
    need = pairs.select("id").unionByName(pairs.select(F.col("neighbour").alias("id"))).distinct()
    kept = cut_lineage(reps.select("id", "v").join(need, "id", "left_semi"))
    both = pairs.join(kept.withColumnRenamed("v", "x"), "id").join(kept.select(F.col("id").alias("neighbour"), F.col("v").alias("y")), "neighbour")
    exact = both.select("id", "neighbour", _cosines(F.col("x"), F.col("y")).alias("cosine")).where(F.col("cosine") >= least)
    first_k = exact.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("neighbour").alias("n")))), 1, k).alias("b"))
    if members is None:
        return first_k.select("id", F.inline("b")).select(F.col("id").alias(key), F.col("n").alias("neighbour"), (-F.col("c")).alias("cosine"))
    of, first = members
    # representatives' neighbours, each standing for its whole class; then the members of the classes in order
    near = cut_lineage(first_k.select("id", F.inline("b")).select("id", F.col("n").alias("near"), (-F.col("c")).alias("cosine")))
    same = first.select(F.col("rep").alias("near"), "first")
    near = near.join(same, "near", "left").select("id", F.explode(F.coalesce("first", F.array("near"))).alias("neighbour"), "cosine")
    own = first.select(F.col("rep").alias("id"), F.explode("first").alias("neighbour"), F.lit(1.0).alias("cosine"))
    per_rep = near.unionByName(own).groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("neighbour").alias("n")))), 1, k + 1).alias("b")
    )
    everyone = rows.where("ask").select("id").join(of, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    out = everyone.join(per_rep.select(F.col("id").alias("rep"), "b"), "rep")
    mine = F.slice(F.filter("b", lambda s: s["n"] != F.col("id")), 1, k)
    return out.select("id", F.inline(mine)).select(F.col("id").alias(key), F.col("n").alias("neighbour"), (-F.col("c")).alias("cosine"))
