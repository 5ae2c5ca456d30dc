"""Connected components by alternating stars, for graphs of any size and with hubs.

Kiveris et al. ("Connected components in MapReduce and beyond", 2014): every node hands its larger neighbours to its
smallest one, then its smaller ones, until all edges point at the smallest node of their component. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.storage import materialise


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for nodes of ``edges`` (a, b: long) that are not the smallest of their component.

    Edges may point either way, repeat, or join a node to itself; NULL ends are ignored. Each round is a stored table. No edges give no rows.
    """
    at = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct()
    at, mark = _stored(at, label)
    while True:
        both = at.union(at.select(F.col("component").alias("node"), F.col("node").alias("component")))
        least = both.groupBy(F.col("node").alias("_node")).agg(F.min("component").alias("_least"))
        large = both.join(least, F.col("node") == F.col("_node")).where("component > node")
        large = large.select(F.col("component").alias("node"), F.least("node", "_least").alias("component")).distinct()
        least = large.groupBy(F.col("node").alias("_node")).agg(F.min("component").alias("_least"))
        small = large.join(least, F.col("node") == F.col("_node")).where("component <> _least")
        small = small.select(F.col("component").alias("node"), F.col("_least").alias("component"))
        own = least.select(F.col("_node").alias("node"), F.col("_least").alias("component"))
        at, now = _stored(small.union(own).distinct(), label)
        if now == mark:
            return at
        mark = now


def _stored(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    stored = materialise(edges, label)
    low = (1 << 32) - 1
    digest = F.xxhash64("node", "component")
    return stored, tuple(stored.agg(F.count("*"), F.sum(digest.bitwiseAND(F.lit(low))), F.sum(F.shiftrightunsigned(digest, 32))).first())
