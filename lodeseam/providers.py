"""Models behind interfaces; the defaults are deterministic and need no network.

A provider is a plain object with one method over a batch. Real models drop in by subclassing: the object is
shipped to the executors, where ``setup`` runs once per worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


class _Slots(dict):
    """The slot of each word met; of those with a negative sign it is counted behind all others."""

    most = 200_000

    def __missing__(self, token: str) -> int:
        h = hashlib.sha256(token.encode()).hexdigest()
        if len(self) >= self.most:
            self.clear()
        self[token] = slot = int(h[:8], 16) % DIM + (0 if int(h[8], 16) % 2 == 0 else DIM)
        return slot


_SLOTS = _Slots()


class EmbeddingProvider:
    """Signed feature hashing of words by frequency, of unit length; a text without words has the zero vector."""

    dim = DIM

    def setup(self) -> None:
        pass

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        tokens = [(t or "").lower().split() for t in texts]
        length = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        slot = np.fromiter(map(_SLOTS.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(length.sum()))
        row = np.repeat(np.arange(len(tokens)) * (2 * DIM), length)
        n = np.bincount(row + slot, minlength=len(tokens) * 2 * DIM).reshape(len(tokens), 2, DIM)
        v = (n[:, 0] - n[:, 1]).astype(np.float64)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))  # sums of whole numbers, so exact in any order
        return list(np.divide(v, size, out=v, where=size > 0))


class LLMProvider:
    """Rules in place of a language model; subclasses answer prompts."""

    def setup(self) -> None:
        pass

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [p.rsplit("\n", 1)[-1] if p else None for p in prompts]


class RerankProvider:
    """Relevance of a text to a query: the F1 of their distinct words."""

    def setup(self) -> None:
        pass

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            a, b = set((q or "").lower().split()), set((t or "").lower().split())
            out.append(2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0)
        return out


def embed(c: Column, provider: EmbeddingProvider | None = None) -> Column:
    """Vectors of texts, Arrow batch by batch; a failing batch gives null vectors, see :func:`mask_failures`."""
    p = provider or EmbeddingProvider()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p.setup()
        for s in batches:
            try:
                yield pd.Series([np.asarray(v, dtype=np.float64) for v in p.embed(s.tolist())], dtype="object")
            except Exception:  # noqa: BLE001
                yield pd.Series([None] * len(s), dtype="object")

    return run(c)


def mask_failures(vector: Column, media_type: Column, dim: int = DIM) -> tuple[Column, Column]:
    """(vector, valid): images and failures get the zero vector and are marked."""
    ok = vector.isNotNull() & (media_type.isNull() | (media_type != "image"))
    return F.when(ok, vector).otherwise(F.array_repeat(F.lit(0.0), dim)), ok


def complete(prompt: Column, provider: LLMProvider | None = None) -> Column:
    p = provider or LLMProvider()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p.setup()
        for s in batches:
            try:
                yield pd.Series(p.complete(s.tolist()), dtype="object")
            except Exception:  # noqa: BLE001
                yield pd.Series([None] * len(s), dtype="object")

    return run(prompt)


def rerank_score(query: Column, text: Column, provider: RerankProvider | None = None) -> Column:
    p = provider or RerankProvider()

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(p.score(list(zip(q, t, strict=True))), dtype="float64")

    return run(query, text)
