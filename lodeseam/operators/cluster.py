"""Soft clustering of vectors: principal components, then mixtures of Gaussians, their number by BIC."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows at most that models are fitted on (by hash); all rows are assigned.
FIT_ROWS = 20_000
#: Steps at most of one mixture, and the gain in mean log likelihood that ends it sooner.
STEPS, GAIN = 200, 1e-3


class Mixture:
    """A mixture of ``k`` Gaussians with full covariances, started from k-means."""

    def __init__(self, x: np.ndarray, k: int, seed: int) -> None:
        n, d = x.shape
        share = np.eye(k)[_means(x, k, np.random.default_rng(seed))]
        last = -math.inf
        for _ in range(STEPS):
            weight = share.sum(axis=0) + 1e-10
            self.weight, self.mean = weight / n, share.T @ x / weight[:, None]
            self.whiten = np.empty((k, d, d))
            for c in range(k):
                off = x - self.mean[c]
                self.whiten[c] = np.linalg.inv(np.linalg.cholesky((share[:, c, None] * off).T @ off / weight[c] + 1e-6 * np.eye(d)))
            p = self.scores(x)
            top = p.max(axis=1, keepdims=True)
            like = top + np.log(np.exp(p - top).sum(axis=1, keepdims=True))
            share, now = np.exp(p - like), float(like.mean())
            if abs(now - last) < GAIN:
                break
            last = now
        self.bic = -2 * n * now + (k - 1 + k * d + k * d * (d + 1) // 2) * math.log(n)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of every row in every component."""
        d = x.shape[1]
        far = [(((x - m) @ w.T) ** 2).sum(axis=1) / 2 - np.log(np.diag(w)).sum() for m, w in zip(self.mean, self.whiten)]
        return np.log(self.weight) - np.stack(far, axis=1) - d / 2 * math.log(2 * math.pi)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Clusters of k-means from far-apart rows."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else 0])
    centre, of = np.stack(centres), np.full(len(x), -1)
    for _ in range(300):
        near = np.argmin((centre**2).sum(axis=1) - 2 * x @ centre.T, axis=1)
        if (near == of).all():
            break
        of = near
        n = np.bincount(of, minlength=k)
        total = np.stack([np.bincount(of, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return of


def cluster_vectors(vectors: DataFrame, most: int = 20, reduce_to: int = 10, seed: int = 42, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id, cluster``: of mixtures of 2, 3 and so on to ``most`` components (a third of the rows at most) the one of lowest BIC; too few rows are one cluster.

    Every number is tried, each in a task of its own over the rows for fitting.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = vectors.select("id", array_to_vector("v").alias("raw"))
    n = df.count()
    top = min(most, n // 3)
    if top < 2:
        return vectors.select("id", F.lit(0).alias("cluster"))
    share = min(1.0, fit_rows / n)
    sample = df.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    pca = PCA(k=reduce_to, inputCol="raw", outputCol="features").fit(sample)
    reduced = lambda rows: pca.transform(rows).select("id", vector_to_array("features").alias("x"))
    fit = np.stack(reduced(sample).toPandas().sort_values("id")["x"].to_numpy())

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"], "bic": [Mixture(fit, int(k), seed).bic for k in pdf["k"]]})

    spark = vectors.sparkSession
    tried = spark.createDataFrame([(k,) for k in range(2, top + 1)], "k long").repartition(top - 1, "k").groupBy("k").applyInPandas(measure, "k long, bic double").collect()
    best = Mixture(fit, min((r["bic"], r["k"]) for r in tried)[1], seed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "cluster": best.scores(np.stack(pdf["x"].to_numpy())).argmax(axis=1)})

    return reduced(df).mapInPandas(assign, "id long, cluster int")
