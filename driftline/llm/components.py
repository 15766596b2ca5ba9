"""Connected components of a graph of many edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _nearest(pairs: DataFrame) -> DataFrame:
    """The smallest of u and its neighbours v, written: joined as a table, its hubs can be split."""
    return materialize(pairs.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.min("u")).alias("m")), "star")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: longs), root the smallest node of its component. Each round is written to the shared folder; rounds grow with the logarithm of the longest path."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        small = large.join(_nearest(large), F.col("u") == F.col("of"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
