"""Data-quality reports; each is one pass over the table, turned into rows at the end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import column_quantiles


def _rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    return df.agg(F.array(*structs).alias("_x")).select(F.inline("_x"))


def null_profile(df: DataFrame, warn: float = 0.05, fail: float = 0.2, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """column, nulls, pct, status; thresholds override fail per column."""
    out = _rows(df, [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count("*").alias("rows"), F.lit(float((thresholds or {}).get(c, fail))).alias("most")) for c in df.columns])
    share = F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0)
    return out.select("column", "nulls", F.round(100 * share, 4).alias("pct"), F.when(share > F.col("most"), "FAIL").when(share > warn, "WARN").otherwise("OK").alias("status"))


def duplicate_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, extra full rows (rows less distinct rows), rows whose key is there more than once, and how many keys that are."""
    full = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("extra_rows"))
    key = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("key_rows"), F.count("*").alias("keys"))
    return full.crossJoin(key)


def range_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, violations, share, for conditions that must hold (null counts as no violation)."""
    out = _rows(df, [F.struct(F.lit(n).alias("rule"), F.count_if(~ok).alias("violations"), F.count("*").alias("rows")) for n, ok in rules.items()])
    return out.select("rule", "violations", F.round(F.col("violations") / F.col("rows"), 8).alias("share"))


def integrity(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """rows, orphans, pct, and the five smallest orphan keys."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct()
    by_key = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_c")).agg(F.count("*").alias("n"))
    judged = by_key.join(known, F.col("_c") == F.col("_k"), "left")
    lost = judged.filter("_k IS NULL")
    sample = lost.orderBy("_c").limit(5).agg(F.array_join(F.sort_array(F.collect_list("_c")), ",").alias("sample"))
    counts = judged.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("n"))), F.lit(0)).alias("orphans"))
    return counts.crossJoin(sample).select("rows", "orphans", F.round(100 * F.col("orphans") / F.col("rows"), 4).alias("pct"), "sample")


def freshness(df: DataFrame, ts: str, as_of: str, most_days: int) -> DataFrame:
    newest = df.agg(F.max(ts).alias("newest"))
    lag = F.datediff(F.to_date(F.lit(as_of)), F.to_date("newest"))
    return newest.select("newest", lag.alias("lag_days"), F.when(lag > most_days, "STALE").otherwise("FRESH").alias("status"))


def outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5, z: float = 3.0) -> DataFrame:
    """column, fences, how many lie outside them and how many beyond z standard deviations."""
    quarters = column_quantiles(df, columns, [0.25, 0.75], "q_")
    moments = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"m_{c}") for c in columns])
    stats = quarters.crossJoin(moments).select(*[F.struct(F.col(f"q_{c}")[0].alias("q1"), F.col(f"q_{c}")[1].alias("q3"), f"m_{c}.m", f"m_{c}.s").alias(f"_{c}") for c in columns])
    both = df.select(*columns).crossJoin(F.broadcast(stats))

    def of(c):
        s, x = F.col(f"_{c}"), F.col(c)
        lo, hi = s["q1"] - k * (s["q3"] - s["q1"]), s["q3"] + k * (s["q3"] - s["q1"])
        return F.struct(F.lit(c).alias("column"), F.first(lo).alias("low"), F.first(hi).alias("high"), F.count_if((x < lo) | (x > hi)).alias("by_fence"), F.count_if(F.abs((x - s["m"]) / s["s"]) > z).alias("by_z"))

    return _rows(both, [of(c) for c in columns])


def gates(df: DataFrame, checks: Mapping[str, tuple[Column, float, float]]) -> DataFrame:
    """gate, value, status: aggregates that must lie between two bounds."""
    out = _rows(df, [F.struct(F.lit(n).alias("gate"), v.cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (v, lo, hi) in checks.items()])
    return out.select("gate", "value", F.when(F.col("value").between(F.col("lo"), F.col("hi")), "pass").otherwise("warn").alias("status"))


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """table, column, type, rows, non_null, null_pct, distinct."""
    out = _rows(df, [F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.count("*").alias("rows"), F.count(c).alias("non_null"), F.count_distinct(c).alias("distinct")) for c, t in df.dtypes])
    return out.withColumn("null_pct", F.round(100 * (1 - F.col("non_null") / F.col("rows")), 4))


def inferred_key(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Whether the parent's column is unique, and what share of the child's distinct values it holds."""
    unique = parent.agg((F.count(parent_key) == F.count_distinct(parent_key)).alias("unique"))
    values, known = child.select(F.col(child_key).alias("v")).distinct(), parent.select(F.col(parent_key).alias("k")).distinct()
    held = values.join(known, F.col("v") == F.col("k"), "left").agg(F.avg(F.col("k").isNotNull().cast("double")).alias("contained"))
    return unique.crossJoin(held)


def near_constant(df: DataFrame, columns: Sequence[str], share: float = 0.8) -> DataFrame:
    """column, its most frequent value and that value's share, where the share is over the limit. Counts combine before the shuffle."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.max_by("value", F.struct("n", "value")).alias("value"), (F.max("n") / F.sum("n")).alias("share"))
    return best.filter(F.col("share") > share)


def missing_informative(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.groupBy(F.col(column).isNull().alias("missing")).agg(F.count("*").alias("n"), F.avg(target).alias("rate"))
