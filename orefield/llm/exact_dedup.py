r"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary of every partition, merged, finds the digests that many rows share. Their winners are
verified by an exact count and broadcast, so the copies of a hot text are settled where they lie, without a
shuffle. The summary's size bounds the broadcast. All other digests go through an ordinary shuffle: an aggregate, which
combines before it, and a join of its winners.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Counters in each partition's summary, and the most digests whose winners are broadcast (about 100 bytes each).
SUMMARY_SIZE = 1024


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]{2,}|[\x09-\x0D]", " ")


def trim(counts: Counter, size: int) -> Counter:
    """The Misra-Gries step for a whole batch: take the count that ranks size + 1 from all and keep what is left."""
    if len(counts) <= size:
        return counts
    least = sorted(counts.values(), reverse=True)[size]
    return Counter({k: n - least for k, n in counts.items() if n > least})


def summarise(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = trim(counts, size)
        yield pa.record_batch({"digest": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", summary_size: int = SUMMARY_SIZE) -> DataFrame:
    """One row per row of docs: key, keep_id (key of the row that stays), group_size, kept, text_sha256.

    The row with the smallest key stays. Null text counts as empty, a null key comes after all others, and of rows
    that repeat both key and text exactly one is kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.written(
        docs.select(
            F.col(key).alias("id"),
            F.sha2(normalised(F.col(text)), 256).alias("digest"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "digests",
    )
    frequent = (
        rows.select("digest")
        .mapInArrow(summarise(summary_size), "digest string, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "digest")
        .limit(summary_size)
        .select("digest")
    )
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "at")
    winners = scratch.written(
        rows.join(F.broadcast(frequent), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(rank).alias("best"), F.count("*").alias("group_size")),
        "winners",
    )
    hot = rows.join(F.broadcast(winners), "digest")
    rare = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    first = rare.groupBy("digest").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    rest = rare.join(first, "digest").select("digest", "id", "at", "best", "group_size")
    return hot.select(rest.columns).unionByName(rest).select(
        F.col("id").alias(key),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.at") == F.col("at")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
