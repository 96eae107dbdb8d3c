"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Forest:
    """Groups of the entries of one bucket: of many links between probes and entries, those that join groups."""

    def __init__(self, entries: int):
        self.group = np.arange(entries)

    def join(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of links (probe, entry), sorted by probe, one to each group that the probe touches; these are one group from then on."""
        if not len(rows):
            return rows, cols
        a, b = [], []
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for row, found in zip(rows[np.r_[0, cuts]], np.split(cols, cuts), strict=True):
            groups, first = np.unique(self.group[found], return_index=True)
            a.append(np.full(len(groups), row))
            b.append(found[first])
            if len(groups) > 1:
                self.group[np.isin(self.group, groups)] = groups[0]
        return np.concatenate(a), np.concatenate(b)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    ``edges`` has two long columns. A large star links every larger neighbour of a node to the smallest one
    it has, a small star every smaller one; when neither changes anything, each node hangs on the smallest
    of its component. The rounds grow with the logarithm of the nodes. Minima are taken before the shuffle,
    and a hub's edges meet only its one minimum in the join, so adaptive execution can split them. Each round
    is checkpointed to the shared folder. Self loops are ignored; nulls are not allowed.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now, before = _saved(now), None
    while (mark := _mark(now)) != before:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u != v").unionByName(lowest.select("u", F.col("m").alias("v")))
        now = _saved(small.distinct())
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _saved(edges: DataFrame) -> DataFrame:
    return edges.checkpoint()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge tables: their number and a sum of 128 bits over them."""
    sums = [F.sum(F.xxhash64(F.lit(s), "u", "v").cast("decimal(38,0)")) for s in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())
