"""Exact quantiles of columns with any number of distinct values, in bounded buffers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Values strictly inside a range that are few enough to be put in order; parts that a sketch cuts a range into.
HELD, PARTS = 1 << 16, 256


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), held: int = HELD) -> DataFrame:
    """by and quantiles: an array of doubles, one for each of at, interpolated as percentile() does; nulls don't count.

    For each group and quantile a range of values is known to hold the two order statistics around it. A sketch of the
    rows inside cuts it, and counts of the rows under and in the new range prove that it still holds them, until at most
    held values lie strictly inside. Only these are ordered, each value once, so ties and huge groups need no larger buffer.
    Ranges are rows of a small table, written after each round. A table without values gives no rows.
    """
    names = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    keys = [F.col(c).alias(k) for c, k in zip(by, names)] or [F.lit(0).alias("_k0")]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")

    def kept(table: DataFrame) -> DataFrame:
        return written(table, "quantiles")

    def inside(ranges: DataFrame) -> DataFrame:
        """Rows in their group's ranges, ends included."""
        other = ranges.select(*[F.col(k).alias(f"_r{k}") for k in names], *[c for c in ranges.columns if c not in names])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in names])
        return rows.join(other, same & F.col("_v").between(F.col("lo"), F.col("hi"))).drop(*[f"_r{k}" for k in names])

    grid = F.percentile_approx("_v", [j / PARTS for j in range(PARTS + 1)], 16 * PARTS)
    # the first cut is one for all quantiles of a group, so it takes a row a group
    whole = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), grid.alias("g"))
    k = [F.lit(float(q)) * (F.col("n") - 1) for q in at]
    cut = lambda i, step: F.element_at("g", F.least(F.greatest(F.floor(k[i] / F.col("n") * PARTS).cast("int") + step, F.lit(1)), F.lit(PARTS + 1)))
    few = F.col("n") <= held
    ends = {f"{name}{i}": F.when(few, F.col(end)).otherwise(cut(i, step)) for i in range(len(at)) for name, step, end in (("low", 0, "lo"), ("high", 3, "hi"))}
    first = kept(whole.select(*names, "n", "lo", "hi", *[v.alias(c) for c, v in ends.items()]))
    other = first.select(*[F.col(x).alias(f"_r{x}") for x in names], *first.columns[len(names) :])
    same = reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(f"_r{x}")) for x in names])
    v = F.col("_v")
    sums = [f for i in range(len(at)) for f in (F.count_if(v < F.col(f"low{i}")).alias(f"under{i}"), F.count_if(v.between(F.col(f"low{i}"), F.col(f"high{i}"))).alias(f"rows{i}"), F.count_if((v > F.col(f"low{i}")) & (v < F.col(f"high{i}"))).alias(f"open{i}"))]
    counted = rows.join(other, same).groupBy(*names).agg(*sums, *[F.first(c).alias(c) for c in first.columns[len(names) :]])

    def ranged(i: int) -> Column:
        """The cut where it holds both order statistics, else the whole."""
        holds = (F.floor(k[i]) >= F.col(f"under{i}")) & (F.ceil(k[i]) < F.col(f"under{i}") + F.col(f"rows{i}"))
        parts = {"lo": (f"low{i}", F.col("lo")), "hi": (f"high{i}", F.col("hi")), "under": (f"under{i}", F.lit(0)), "rows": (f"rows{i}", F.col("n")), "open": (f"open{i}", F.col("n"))}
        return F.struct(F.lit(i).alias("i"), k[i].alias("k"), *[F.when(holds, F.col(new)).otherwise(old).alias(c) for c, (new, old) in parts.items()])

    state = kept(counted.select(*names, F.inline(F.array(*[ranged(i) for i in range(len(at))]))))
    columns = state.columns
    while True:
        wide = (F.col("open") > held) & (F.col("lo") < F.col("hi"))
        todo = state.filter(wide)
        if todo.isEmpty():
            break
        near = inside(todo)
        cell = F.floor((F.col("k") - F.col("under")) / F.col("rows") * PARTS).cast("int")
        cuts = near.groupBy(*names, "i").agg(grid.alias("g"), *[F.first(c).alias(c) for c in ("k", "lo", "hi", "under", "rows", "open")])
        cuts = kept(cuts.withColumns({"low": F.element_at("g", F.greatest(cell, F.lit(1))), "high": F.element_at("g", F.least(cell + 3, F.lit(PARTS + 1)))}).drop("g"))
        low, high = F.col("low"), F.col("high")
        counts = inside(cuts).groupBy(*names, "i").agg(
            F.count_if(v < low).alias("below"), F.count_if(v.between(low, high)).alias("new_rows"), F.count_if((v > low) & (v < high)).alias("new_open"), *[F.first(c).alias(c) for c in (*columns[len(names) + 1 :], "low", "high")]
        )
        holds = (F.floor("k") >= F.col("under") + F.col("below")) & (F.ceil("k") < F.col("under") + F.col("below") + F.col("new_rows"))
        pick = lambda new, old: F.when(holds, new).otherwise(F.col(old)).alias(old)
        # a range that didn't narrow is put in order as it is
        fresh = counts.select(*names, "i", "k", pick(low, "lo"), pick(high, "hi"), pick(F.col("under") + F.col("below"), "under"), pick(F.col("new_rows"), "rows"), F.when(holds & (F.col("new_open") < F.col("open")), F.col("new_open")).otherwise(F.lit(0)).cast("long").alias("open"))
        state = kept(state.filter(~wide).unionByName(fresh.select(columns)))
    values = inside(state).groupBy(*names, "i", "k", "under", "_v").agg(F.count("*").alias("c"))
    upto = F.col("under") + F.sum("c").over(Window.partitionBy(*names, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ends = values.withColumn("upto", upto).groupBy(*names, "i", "k").agg(F.min(F.when(F.col("upto") > F.floor("k"), F.col("_v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("k"), F.col("_v"))).alias("b"))
    part = F.col("k") - F.floor("k")
    each = ends.select(*names, F.struct("i", F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("x")).alias("s"))
    out = each.groupBy(*names).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, names)], F.col("s.x").alias("quantiles"))


def column_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], prefix: str = "_") -> DataFrame:
    """One row: for each column the array of its quantiles, under its name after the prefix; null where it has no value."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])))
    found = quantiles(long, "value", at, ["column"])
    return found.agg(*[F.max(F.when(F.col("column") == c, F.col("quantiles"))).alias(f"{prefix}{c}") for c in columns])
