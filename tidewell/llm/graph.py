"""Connected components over edge tables, without collecting edges anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, redeal


class Forest:
    """Union-find over 0..n-1 on whole edge arrays; the root of a tree is its smallest node."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            a, b = parent[a], parent[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of every node that isn't a root."""
        below = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return below, self.parent[below]


def _mark(df: DataFrame):
    """What tells two edge sets apart: their size, and a sum and an exclusive-or of hashes."""
    return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31)), F.bit_xor(F.xxhash64("b", "a"))).first()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    edges: columns a, b (long); loops and repeats are allowed. Large-star and small-star rounds
    (Kiveris et al., 2014) run until nothing changes; each round ends with a checkpoint. A hub's
    rows meet only in joins that Spark can split, never in one task.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = redeal(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(redeal(least, "a"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        last, mark = mark, _mark(now)
        if last == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
