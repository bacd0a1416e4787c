"""Splits, folds and samples that are the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import quantiles


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def hash_share(key: str, seed: int) -> Column:
    """A number in [0, 1) that only depends on key and seed."""
    return F.pmod(hash_order(key, seed), F.lit(1 << 30)) / float(1 << 30)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(n)


def random_split(df: DataFrame, test: float, key: str, seed: int = 7) -> DataFrame:
    return df.withColumn("split", F.when(hash_share(key, seed) < test, "test").otherwise("train"))


def temporal_split(df: DataFrame, ts: str, test: float) -> DataFrame:
    """The newest share is test. The cut is a timestamp, so rows of one instant are never parted."""
    at = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    cut = quantiles(at, "at", [1 - test]).agg(F.first(F.col("quantiles")[0]).alias("_cut"))
    late = F.unix_micros(F.col(ts).cast("timestamp")) > F.col("_cut")
    return df.crossJoin(F.broadcast(cut)).withColumn("split", F.when(late, "test").otherwise("train")).drop("_cut")


def stratified_split(df: DataFrame, stratum: str, key: str, test: float, seed: int = 7) -> DataFrame:
    """In each stratum the first share of rows in hash order is test."""
    w = Window.partitionBy(stratum)
    place = F.row_number().over(w.orderBy(hash_order(key, seed), key))
    return df.withColumn("split", F.when(place <= F.round(test * F.count("*").over(w)), "test").otherwise("train"))


def fold_of(key: str, k: int, seed: int = 7) -> Column:
    return F.pmod(hash_order(key, seed), F.lit(k)).cast("int")


def group_folds(df: DataFrame, group: str, folds: int, repeats: int, seed: int = 7) -> DataFrame:
    """group, repeat, fold: in each repeat every group has one fold, and folds have as many groups as can be."""
    groups = df.select(group).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    place = F.row_number().over(Window.partitionBy("repeat").orderBy(F.xxhash64(F.lit(seed), "repeat", group), group))
    return groups.withColumn("fold", F.pmod(place - 1, F.lit(folds)).cast("int"))


def weighted_copies(weight: Column, n: int, total: Column, key: str, seed: int = 7) -> Column:
    """How often a weighted sample with replacement takes the row: its expected number, rounded up or down by hash."""
    want = n * weight / total
    return (F.floor(want) + (hash_share(key, seed) < want - F.floor(want)).cast("int")).cast("int")
