"""Connected components of an edge table, by alternating large-star and small-star steps on Spark joins.

Kiveris et al., Connected Components in MapReduce and Beyond (2014). Each step takes the smallest neighbour of every
node by an aggregate (which combines before the shuffle) and joins it back to the edges. The table of smallest
neighbours is written first, so both sides of that join are plain shuffles, in which Spark can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node a to the smaller node b."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges a, b (long) but the roots; a root is its component's smallest node."""
    now, before = scratch.written(directed(edges), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.written(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m")), "large")
        large = scratch.written(now.join(least, now["b"] == least["u"]).select("a", F.col("m").alias("b")).distinct(), "large-star")
        least2 = scratch.written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "small")
        small = large.join(least2, large["a"] == least2["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.written(small.filter("a <> b").unionByName(least2.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        for old in (now, least, large, least2):
            scratch.drop(old)
        now = new
