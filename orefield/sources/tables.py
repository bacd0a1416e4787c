"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """By the suffix: csv (with header), json or jsonl, text, orc, else Parquet. Folders and globs are shards of one table."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.option("header", options.get("header", "true")).csv(path)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind in ("txt", "text"):
        return reader.text(path)
    return reader.orc(path) if kind == "orc" else reader.parquet(path)


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One table of several files by column name; columns that a shard lacks are null."""
    first, *rest = [read_table(spark, p) for p in paths]
    for shard in rest:
        first = first.unionByName(shard, allowMissingColumns=True)
    return first


def read_documents(spark: SparkSession, path: str, separator: str, min_chars: int = 1) -> DataFrame:
    """Documents between separators, trimmed, of min_chars or more."""
    text = spark.read.option("lineSep", separator).text(path).select(F.btrim("value", F.lit(" \t\r\n")).alias("text"))
    return text.filter(F.length("text") >= min_chars)


def labelled_fields(text: Column, fields: Sequence[str]) -> Column:
    """Struct of what follows each 'Field:' up to the next field or the end; null where a field isn't there."""
    stop = "|".join(f"{f}:" for f in fields)

    def of(f):
        found = F.regexp_extract(text, rf"(?s)(?:^|\n)\s*{f}:\s*(.*?)\s*(?=\n\s*(?:{stop})|\z)", 1)
        return F.when(F.contains(text, F.lit(f"{f}:")), found).alias(f.lower())

    return F.struct(*map(of, fields))


def append_ledger(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to what is there."""
    df.write.mode("append").json(path)


def melted(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, key, value: one row for each metric that isn't null."""
    rows = F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in metrics])
    return wide.select(*keys, F.inline(rows)).filter("value IS NOT NULL")


def content_hash(df: DataFrame) -> DataFrame:
    """rows and a hash that doesn't depend on the order of rows or partitions."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor("h").alias("folded"))


def save_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), options: Mapping[str, str] | None = None) -> None:
    writer = df.write.mode(mode).options(**(options or {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
