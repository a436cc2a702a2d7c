"""What the two vector operators share: valid vectors, bounded samples and k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(embedding: str = "embedding") -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    c = F.col(embedding)
    return c.isNotNull() & ~F.exists(c, bad) & F.exists(c, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sample(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """At most `most` vectors of (embedding), drawn by their hash and so the same at every run, by length."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(most).collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r[0]), []).append(r[0])
    return {n: np.array(x, np.float64) for n, x in out.items()}


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] / 2 - x @ centres.T).argmin(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k centres at most; a centre that loses all its vectors keeps its place."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))]
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres
