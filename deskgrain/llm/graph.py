"""Connected components of very large graphs by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (src long, dst long; in any direction, repeats allowed) but the roots themselves.

    ``root`` is the smallest node of the component. Each round joins the edges with one minimum for each node
    (aggregated before it is shuffled); rounds are written to the shared folder, so that no lineage grows and a lost
    executor costs one round at most. Self-loops and nulls are no links; without edges the result is empty. Rounds grow
    with the logarithm of the longest chain; none follows once all edges lead to roots.
    """
    e = written(edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while _unfinished(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges whose larger end saw no smaller minimum: its own neighbours below keep it linked
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        near = large.join(low, F.col("u") == F.col("k"))
        small = near.where("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v"),
        ).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _unfinished(e: DataFrame) -> bool:
    """Whether some node has edges to two smaller ones, or one to a smaller and one to a larger: else all edges lead to roots."""
    ends = e.select(F.col("u").alias("k"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        e.select(F.col("v").alias("k"), F.lit(0).alias("down"), F.lit(1).alias("up")),
    )
    both = ends.groupBy("k").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return both.where("down > 1 OR down = 1 AND up = 1").limit(1).count() > 0


def union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the components of the links (x, y): label[i] is the smallest index of i's component."""
    while True:
        lx, ly = label[x], label[y]
        open_ = lx != ly
        if not open_.any():
            return
        x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while not np.array_equal(label, further := label[label]):
            label[:] = further
