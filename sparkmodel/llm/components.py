"""Connected components of a link table, on the executors only, and the union-find used inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmodel.llm.runtime import drop_table, written


class Forest:
    """Union-find over 0..n-1 for arrays of pairs; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.parent[x]
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def labels(self) -> np.ndarray:
        return self.roots(np.arange(len(self.parent)))


def components(links: DataFrame) -> DataFrame:
    """links (a, b: bigint, not null) to one row (node, root) per linked node, root being the smallest node reachable.

    Alternates the large-star and small-star steps: each replaces a node's links by links to the smallest neighbour,
    until every node hangs on its component's smallest. Minima are aggregated before the shuffle and rows of a hub are
    never gathered: they meet their hub's minimum in a join whose partitions adaptive execution can split. Each
    round's links are written to the shared folder, so a lost executor costs at most a part of one round.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(canonical(links), "links")
    state = summary(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = canonical(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        then = written(canonical(small), "links")
        after = summary(then)
        drop_table(now)
        now = then
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
