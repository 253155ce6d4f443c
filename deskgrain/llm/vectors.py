"""Shared by the vector operators: which vectors take part, bounded samples, k-means, and packing into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled

#: Vectors that k-means may be fitted on; the sample is the one of the smallest id hashes.
SAMPLE = 20_000


def takes_part(v: Column) -> Column:
    """Whether a vector is not null, holds finite components only, and not only zeros."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def sample(df: DataFrame, id_col: str, vec_col: str, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` vectors, one row each, the same ones in every run."""
    h = F.xxhash64(id_col)
    rows = sampled(df, h, df.count(), most).select(h.alias("h"), F.col(vec_col).alias("v")).orderBy("h", "v").limit(most).select("v").toArrow()
    flat = rows.column(0).combine_chunks()
    return to_matrix(flat) if len(flat) else np.empty((0, 1))


def to_matrix(lists: pa.ListArray) -> np.ndarray:
    """A list array of vectors of one length as a float64 matrix."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def kmeans(x: np.ndarray, k: int, spherical: bool, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centres of k-means on ``x`` (of unit length if ``spherical``); fewer than k if ``x`` has fewer distinct rows."""
    if spherical:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    c = distinct[np.sort(np.random.default_rng(seed).choice(len(distinct), k, replace=False))]
    for _ in range(rounds):
        home = nearest(x, c)
        total, n = np.zeros_like(c), np.bincount(home, minlength=k)
        np.add.at(total, home, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if spherical:
            norm = np.linalg.norm(c, axis=1, keepdims=True)
            c = c / np.where(norm > 0, norm, 1)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances up to a constant of each row of x."""
    return (c * c).sum(1) - 2 * (x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)
