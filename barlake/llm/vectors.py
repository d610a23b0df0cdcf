"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that have a direction: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_size(vectors: DataFrame, col: str) -> int:
    """The most frequent number of components, the larger of several; 0 for an empty table."""
    found = vectors.groupBy(F.size(col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column as rows of doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither huge nor tiny components overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def packed(x: np.ndarray) -> pa.Array:
    """Rows of numbers as a list column."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's rounds from a random start; never more than there are rows."""
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        home = nearest(x, centres)
        counts = np.bincount(home, minlength=k)
        sums = np.stack([np.bincount(home, x[:, d], k) for d in range(x.shape[1])], 1)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Number of the closest centre of each row."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + rows] @ centres.T - half, 1) for i in range(0, len(x), rows)] or [np.zeros(0, int)])
