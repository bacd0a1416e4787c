"""Mixing sources to target weights by capped water-filling, then whole and fractional repetitions of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, count_words, fresh, positions

#: Hash buckets into which every source is dealt at least before its fractional repetition is cut, and rows that one of them has on average at most.
BUCKETS, BUCKET_ROWS = 4096, 20_000


def water_fill(sources: DataFrame, total: float, max_epochs: float, scratch: Scratch) -> DataFrame:
    """Add target to sources (source_size, weight): total by weight, where no target exceeds max_epochs * source_size.

    Sources above their cap are clamped to it and what they leave goes to the others by weight, until none is above.
    Each round is one aggregate over the table of sources and clamps one source at least.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    now = sources.withColumn("clamped", F.lit(False))
    while True:
        free = ~F.col("clamped") & (F.col("weight") > 0)
        sums = now.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(F.col("clamped"), cap)).alias("used")).first()
        left = max(0.0, total - (sums["used"] or 0.0))
        level = left / sums["w"] if sums["w"] else 0.0
        share = F.when(F.col("clamped"), cap).otherwise(F.col("weight") * F.lit(level))
        above = ~F.col("clamped") & (share > cap)
        if not sums["w"] or not now.filter(above).limit(1).count():
            return now.withColumn("target", share.cast("double")).drop("clamped")
        now = scratch.written(now.withColumn("clamped", F.col("clamped") | above), "clamped")


def mix(docs: DataFrame, *, buckets: int | None = None, **options) -> DataFrame:
    """One row per row of docs: key, size, source, source_size, target, repeats, taken (= repeats * size); see _mixed."""
    out, made = _mixed(docs, buckets=buckets, **options)
    key, source = options.get("key", "doc_id"), options.get("source", "source")
    return out.select(docs[key], *[F.col(made[c]).alias(c) for c in ("size",)], docs[source], *[F.col(made[c]).alias(c) for c in ("source_size", "target", "repeats", "taken")])


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with its columns and the number of the copy (copy, from 1).

    A column of docs called copy is kept; the number is then called copy_. Options as of mix. Each row of docs is
    looked at by itself, so rows that repeat are never multiplied by each other.
    """
    out, made = _mixed(docs, **options)
    copy = fresh(out, "copy")
    taken = out.filter(F.col(made["repeats"]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(made["repeats"]).cast("int"))))
    return taken.select(*docs.columns, copy)


def _mixed(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, buckets: int | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """docs with five more columns, and the names of these (which no column of docs has).

    Sources in code-point order, null last, get the weights in turn. The mix has share times all words. A target of
    r times its source's size takes every document floor(r) times, and once more those that come first in a seeded
    order until the rest is nearest: at most half a document off. The order is by hash bucket; only the bucket in
    which the cut falls is sorted, so a hot source is never in one task, and no text is shuffled but those of that
    bucket. Null or empty texts have size 0. An empty table gives no rows; reruns give the same repeats. Keys have any
    type and may be null or repeat; of rows with the same key and source it doesn't matter which is taken more often.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    h = F.xxhash64(F.lit(seed), F.col(key))
    sized = scratch.written(docs.select(F.col(source).alias("src"), count_words(F.col(text)).alias("size"), h.alias("h")), "sizes")
    n_buckets = F.lit(buckets or max(BUCKETS, -(-sized.count() // BUCKET_ROWS)))
    by_bucket = scratch.written(sized.groupBy("src", F.pmod("h", n_buckets).alias("bucket")).agg(F.sum("size").alias("n")), "buckets")
    scratch.drop(sized)
    by_source = by_bucket.groupBy("src").agg(F.sum("n").alias("source_size"))
    ranked = positions(by_source, F.col("src").asc_nulls_last(), scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighted = scratch.written(ranked.withColumn("weight", weight).drop("position"), "sources")
    total = (weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = scratch.written(
        water_fill(weighted, total, max_epochs, scratch).select(
            F.col("src").alias("s"), "source_size", "target", F.floor(r).alias("whole"), (F.col("target") - F.floor(r) * F.col("source_size")).alias("part")
        ),
        "targets",
    )
    # the bucket in which each source's cut falls, and the words still wanted there
    before = F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")
    cuts = (
        by_bucket.withColumn("before", before)
        .join(sources, F.col("src").eqNullSafe(F.col("s")))
        .filter(F.col("before") < F.col("part"))
        .groupBy(F.col("s").alias("c"))
        .agg(F.max_by(F.struct("bucket", (F.col("part") - F.col("before")).alias("want")), "bucket").alias("cut"))
    )
    plan = sources.join(cuts, F.col("s").eqNullSafe(F.col("c")), "left").select("s", "source_size", "target", "whole", F.coalesce("cut.bucket", F.lit(-1)).alias("cut"), F.coalesce("cut.want", F.lit(0.0)).alias("want"))
    made = {c: fresh(docs, c) for c in ("source_size", "target", "whole", "cut", "want", "s", "size", "h", "bucket", "extra", "repeats", "taken", "sum")}
    # written, so its size is known: Spark broadcasts a small table of sources and splits a hot source in a join with a large one
    plan = scratch.written(plan, "plan").withColumnsRenamed(made)
    col = {c: F.col(name) for c, name in made.items()}
    dealt = docs.withColumns({made["size"]: count_words(F.col(text)), made["h"]: h}).withColumn(made["bucket"], F.pmod(col["h"], n_buckets))
    dealt = dealt.join(plan, F.col(source).eqNullSafe(col["s"]))
    upto = F.sum(col["size"]).over(Window.partitionBy(col["s"]).orderBy(col["h"], F.col(key), col["size"], F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, 0))
    at_cut = dealt.filter(col["bucket"] == col["cut"]).withColumn(made["sum"], upto)
    at_cut = at_cut.withColumn(made["extra"], (col["sum"] - col["size"] / 2 <= col["want"]).cast("long")).drop(made["sum"])
    rest = dealt.filter(col["bucket"] != col["cut"]).withColumn(made["extra"], (col["bucket"] < col["cut"]).cast("long"))
    out = at_cut.unionByName(rest).withColumn(made["repeats"], col["whole"] + col["extra"]).withColumn(made["taken"], col["repeats"] * col["size"])
    return out, made
