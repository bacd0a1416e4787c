"""Connected components of an edge table, by alternating star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder where one is set, which cuts the lineage, else kept by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges a, b; a root is its component's smallest node. Nodes of any ordered type."""
    now = _kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = _kept(now.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct())
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = _kept(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
