"""Quality over time: scores, rolling means, the gate with hysteresis, intervals."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.session import cut_lineage

ROLLING, DEGRADED, RECOVERED = 10, 0.5, 0.7
#: Rows of the global order that one window sees at a time.
BLOCK = 100_000


def score(c: Column) -> Column:
    """A score between 0 and 1; what is no number counts 0."""
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def overall(*scores: Column) -> Column:
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return F.round(total / len(scores), 2)


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``df`` with 0-based positions of a global order, without a window over everything: ranges are sorted
    apart, and only their sizes meet on the driver."""
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    if not before:
        return parts.withColumn(name, F.lit(0).cast("bigint")).drop("_p", "_m")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_p"))
    return parts.withColumn(name, (F.col("_m").bitwiseAND((1 << 33) - 1) + offset).cast("bigint")).drop("_p", "_m")


def rolling_mean(df: DataFrame, value: str, order: list[Column], width: int = ROLLING, digits: int = 6) -> DataFrame:
    """``df`` with ``pos`` and ``mean``, over the last ``width`` rows of the global order.

    Blocks of the order are averaged apart; each sees the last rows of the block before.
    """
    p = positions(df, order).withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("own", F.lit(True))
    edge = p.where(F.col("pos") % BLOCK > BLOCK - width).withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False))
    w = W.partitionBy("block").orderBy("pos").rowsBetween(-(width - 1), 0)
    return p.unionByName(edge).withColumn("mean", F.round(F.avg(value).over(w), digits)).where("own").drop("own")


def quality_gate(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """``df`` with ``pos, mean, degraded``: degraded once the rolling mean is below DEGRADED, until it is above RECOVERED.

    The state at the end of each block is carried over the blocks, of which there are few, and then into them.
    """
    m = rolling_mean(df, value, order)
    turn = F.when(F.col("mean") < DEGRADED, True).when(F.col("mean") > RECOVERED, False)
    m = cut_lineage(m.withColumn("turn", turn))
    ends = m.groupBy("block").agg(F.max_by("turn", F.when(F.col("turn").isNotNull(), F.col("pos"))).alias("end"))
    # one row per BLOCK rows of the table
    carried = ends.withColumn("start", F.last("end", ignorenulls=True).over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select("block", "start")
    w = W.partitionBy("block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    joined = m.join(carried, "block").withColumn("degraded", F.coalesce(F.last("turn", ignorenulls=True).over(w), "start", F.lit(False)))
    return joined.drop("turn", "start", "block")


def bca_interval(x: np.ndarray, statistic: Callable = np.mean, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Bias-corrected and accelerated bootstrap interval; a constant sample gives its value twice."""
    n, value = len(x), statistic(x)
    if n < 2 or np.all(x == x[0]):
        return float(value), float(value)
    rng = np.random.default_rng(seed)
    boot = np.sort([statistic(x[rng.integers(0, n, n)]) for _ in range(resamples)])
    nd = NormalDist()
    below = min(max((np.sum(boot < value) + 0.5 * np.sum(boot == value)) / resamples, 0.5 / resamples), 1 - 0.5 / resamples)
    z0 = nd.inv_cdf(float(below))
    jack = np.array([statistic(np.delete(x, i)) for i in range(n)])
    d = jack.mean() - jack
    a = (d**3).sum() / (6 * ((d**2).sum() ** 1.5) or 1.0)
    out = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + nd.inv_cdf(q)
        out.append(float(np.quantile(boot, nd.cdf(float(z0 + z / (1 - a * z))))))
    return out[0], out[1]


def interval(df: DataFrame, value: str, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """One row ``mean, std, low, high, n`` of all rows: the mean's bias-corrected and accelerated bootstrap interval.

    Each task draws how often a row is in each resample (a Poisson number of mean 1) and returns sums per resample, so
    no row leaves its task. Nulls and NaN are left out; of no rows all is null, and a constant gives its value twice.
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, times = np.zeros(resamples), np.zeros(resamples)
        for pdf in batches:
            v = np.sort(pdf["x"].to_numpy(dtype=float))
            # a retried task draws the same
            rng = np.random.default_rng(zlib.crc32(v.tobytes()))
            for lo in range(0, len(v), 1000):
                w = rng.poisson(1.0, (resamples, len(v[lo : lo + 1000])))
                total += w @ v[lo : lo + 1000]
                times += w.sum(axis=1)
        yield pd.DataFrame({"r": np.arange(resamples), "s": total, "t": times})

    boot = x.mapInPandas(draw, "r int, s double, t double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).where("t > 0")
    boot = boot.agg(F.sort_array(F.collect_list(F.col("s") / F.col("t"))).alias("b"))  # one number per resample
    of = x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n"), F.skewness("x").alias("skew"), F.min("x").alias("low"), F.max("x").alias("high"))

    @F.pandas_udf("struct<low:double,high:double>")
    def bounds(mean: pd.Series, n: pd.Series, skew: pd.Series, low: pd.Series, high: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for m, k, g, lo, hi, r in zip(mean, n, skew, low, high, b, strict=True):
            if k < 2 or lo == hi:
                out.append((m, m))
                continue
            r, nd = np.asarray(r), NormalDist()
            below = min(max((np.sum(r < m) + 0.5 * np.sum(r == m)) / len(r), 0.5 / len(r)), 1 - 0.5 / len(r))
            # the jackknife's acceleration of a mean is its skewness over six times the root of n
            z0, a = nd.inv_cdf(float(below)), g / (6 * k**0.5)
            ends = [z0 + nd.inv_cdf(q) for q in ((1 - level) / 2, (1 + level) / 2)]
            out.append(tuple(float(np.quantile(r, nd.cdf(float(z0 + z / (1 - a * z))))) for z in ends))
        return pd.DataFrame(out, columns=["low", "high"])

    both = of.crossJoin(boot)  # one row each
    return both.select("mean", "std", F.inline(F.array(bounds("mean", "n", "skew", "low", "high", "b"))), "n")
