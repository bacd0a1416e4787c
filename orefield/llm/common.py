"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that the contracts name: blank and \t \n \x0b \x0c \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed (a cluster gets it by --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one on this machine where that is unset and the master local (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='orefield-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written under one new folder of the shared directory; each cuts the lineage of what it holds."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def written(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores where df has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def positions(df: DataFrame, order: Column, scratch: Scratch, name: str = "position") -> DataFrame:
    """df with the 0-based position of each row in that order, without bringing all rows into one task."""
    part = fresh(df, "part")
    dealt = scratch.written(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))  # a row for each task
    offset, of = fresh(dealt, "offset"), fresh(dealt, "of")
    before = counts.select(F.col(part).alias(of), (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(offset))
    here = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return dealt.withColumn(name, here).join(F.broadcast(before), F.col(part) == F.col(of)).withColumn(name, F.col(name) + F.col(offset)).drop(part, of, offset)


def count_words(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in the text; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * 5)
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is (lower() would change other letters too)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words_of(text: bytes) -> list[bytes]:
    r"""[^\x20\x09-\x0D]+ of the text in UTF-8, A-Z lower-cased; bytes.lower and bytes.split know ASCII only."""
    return text.lower().split()


WORD = re.compile(r"\w+")
