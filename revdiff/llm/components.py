"""Connected components by alternating large-star and small-star steps.

Every step is one aggregate and one join on the edges, so no vertex's neighbours are gathered in one
place; the number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revdiff.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of edges (u, v): root is the smallest vertex reachable.

    Self-loops and nulls are left out first; vertices without edges don't appear in the result.
    """
    now = stage(edges.select("u", "v").filter("u <> v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = stage(_small_star(stage(_large_star(now))))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Links among the vertices 0..n-1 of one task, kept as a spanning forest, so that a task gives at most n - 1 of them."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.low[i], self.low[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.low, np.maximum(a, b), np.minimum(a, b))
            while True:
                next_low = self.low[self.low]
                if (next_low == self.low).all():
                    break
                self.low = next_low

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Vertices that have a smaller one, and that smaller one."""
        at = (self.low != np.arange(len(self.low))).nonzero()[0]
        return at, self.low[at]
