"""Aggregates that take more than one built-in function."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .filters import unpivoted
from .ordering import running_by_range
from .quantiles import column_quantiles, quantiles


def average_rank(df: DataFrame, column: str, out: str, partition: Sequence[str] = ()) -> DataFrame:
    """df with the average rank of the column (ties share it). Ranks come from counts per distinct value."""
    counts = df.groupBy(*partition, column).agg(F.count("*").alias("_n"))
    if not partition:
        upto = running_by_range(counts, [F.asc(column)], {"_upto": F.col("_n")})
        return df.join(upto.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), column)
    below = F.sum("_n").over(Window.partitionBy(*partition).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ranks = counts.select(*partition, column, (below + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*partition, column])


def histogram(df: DataFrame, column: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """bin, lower, upper, n: equal widths, the last bin closed, empty bins with 0, values outside left out."""
    if lo is None or hi is None:
        low, high = df.agg(F.min(column), F.max(column)).first()
        lo, hi = low if lo is None else lo, high if hi is None else hi
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", (lo + F.col("bin") * width).alias("lower"), (lo + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts by row and the given values of column, 0 where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"c_{v}") for v in values])


def share_entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: groups, entropy of their shares over ln(groups), smallest and largest share."""
    total = counts.agg(F.sum(n).alias("total"))
    p = F.col(n) / F.col("total")
    return counts.crossJoin(F.broadcast(total)).agg(
        F.count("*").alias("groups"), F.round(-F.sum(p * F.ln(p)) / F.ln(F.count("*")), 6).alias("entropy"), F.round(F.min(p), 6).alias("min_share"), F.round(F.max(p), 6).alias("max_share")
    )


def cohens_d(value: Column, one: Column) -> Column:
    """Difference of the means where one holds and where it doesn't, over the pooled standard deviation."""
    a, b = F.when(one, value), F.when(~one, value)
    pooled = ((F.count(a) - 1) * F.var_samp(a) + (F.count(b) - 1) * F.var_samp(b)) / (F.count(a) + F.count(b) - 2)
    return (F.avg(a) - F.avg(b)) / F.sqrt(pooled)


def cliffs_delta(df: DataFrame, value: str, one: str) -> DataFrame:
    """One row: delta = 2 U / (n1 n0) - 1 by rank sums; one is boolean."""
    ranked = average_rank(df.filter(F.col(value).isNotNull() & F.col(one).isNotNull()), value, "_rank")
    n1, n0 = F.count_if(one), F.count_if(~F.col(one))
    u = F.sum(F.when(F.col(one), F.col("_rank"))) - n1 * (n1 + 1) / 2
    return ranked.agg(n1.alias("n1"), n0.alias("n0"), F.round(2 * u / (n1 * n0) - 1, 6).alias("delta"))


def eta_squared(df: DataFrame, dimensions: Sequence[str], value: str) -> DataFrame:
    """Share of the value's variance that lies between the groups of each dimension, with its best and worst group."""
    long = df.select(F.col(value).alias("v"), F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])))
    groups = long.groupBy("dimension", "level").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.avg("v").alias("m"))
    total = F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - total
    return groups.groupBy("dimension").agg(
        F.round(between / (F.sum("q") - total), 8).alias("eta_squared"), F.max_by("level", F.struct("m", "level")).alias("best"), F.min_by("level", F.struct("m", "level")).alias("worst")
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for each pair of columns, all in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = unpivoted(one, [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ranked = df.select(*columns).na.drop()
    for c in columns:
        ranked = average_rank(ranked, c, f"_r_{c}")
    return correlations(ranked.select(*[F.col(f"_r_{c}").alias(c) for c in columns]), columns)


#: Points of a range of kendall's, about.
POINTS = 1 << 16


def sign_sums(rows: pa.Table) -> pa.Table:
    """The sum of sign(a - a') sign(b - b') n n' over all pairs of rows of the same cell (the columns before a, b, n and after the first)."""
    cells = [c for c in rows.column_names[1:-3]]
    rows = rows.sort_by([(c, "ascending") for c in [*cells, "a", "b"]])
    n = rows.column("n").to_numpy()
    new = np.zeros(len(n), bool)
    new[0] = True
    fresh = new.copy()
    for c in cells:
        fresh |= _changes(rows.column(c))
    other = fresh | _changes(rows.column("a"))
    cell, of_a = np.cumsum(fresh) - 1, np.cumsum(other) - 1
    of_a -= of_a[np.flatnonzero(fresh)][cell]  # numbers of a within the cell
    order = rows.append_column("_i", pa.array(np.arange(len(n)))).sort_by([("b", "ascending")])
    of_b = np.empty(len(n), np.int64)
    of_b[order.column("_i").to_numpy()] = np.cumsum(_changes(order.column("b")))
    s = 0
    by_b = np.lexsort((of_b, cell))
    for level in range(int(of_a.max()).bit_length()):
        # two numbers first differ in one bit: there one is on the left of its block, the other on the right
        at = by_b[np.lexsort((of_a[by_b] >> (level + 1), cell[by_b]))]
        block = np.append(True, (cell[at][1:] != cell[at][:-1]) | (of_a[at][1:] >> (level + 1) != of_a[at][:-1] >> (level + 1)))
        tie = block | np.append(True, of_b[at][1:] != of_b[at][:-1])
        left = np.where(of_a[at] >> level & 1, 0, n[at])
        upto = np.append(0, np.cumsum(left))
        starts, ties = np.flatnonzero(block), np.flatnonzero(tie)
        which, tied = np.cumsum(block) - 1, np.cumsum(tie) - 1
        less = upto[ties][tied] - upto[starts][which]
        more = upto[np.append(starts[1:], len(n))][which] - upto[np.append(ties[1:], len(n))][tied]
        s += int((np.where(of_a[at] >> level & 1, n[at], 0) * (less - more)).sum())
    return pa.table({"s": pa.array([Decimal(s)], pa.decimal128(38, 0))})


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it; not so the first."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    if not len(whole):
        return np.zeros(0, bool)
    other = pc.not_equal(whole[1:], whole[:-1])
    if pa.types.is_floating(whole.type):  # NaN is one value
        other = pc.and_not(other, pc.and_(pc.is_nan(whole[1:]), pc.is_nan(whole[:-1])))
    return np.append(False, other.to_numpy(zero_copy_only=False))


def kendall(df: DataFrame, x: str, y: str, slots: int = 1024) -> DataFrame:
    """One row: tau, Kendall's tau-b of two columns of any number of values; rows with a null don't count, 0 where a column has one value.

    Spark deals the values of each column into ranges. Pairs of points in different ranges of both columns are counted from
    the weights of the cells of that grid; those in one range of y but not of x from points (range of x, y), those in one of
    x but not of y from (x, range of y), those in one cell from the points themselves. A task counts cells or ranges
    of about a range's points, by bits of their numbers in the order of x; a value that many points share is one there.
    """
    counts = written(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")), "kendall")
    points = counts.count()
    ranges = max(1, min(slots, -(-points // POINTS)))
    dealt = counts
    for c in ("x", "y"):
        dealt = written(dealt.repartitionByRange(ranges, c).withColumn(f"p{c}", F.spark_partition_id()), f"kendall-{c}")

    def signs(cell: list[str], a: str, b: str) -> DataFrame:
        rows = dealt if {"x", "y"} == {a, b} else dealt.groupBy(*{*cell, a, b}).agg(F.sum("n").alias("n"))
        task = F.pmod(F.xxhash64(F.lit(1), *cell), F.lit(4 * ranges))
        named = rows.select(task.alias("task"), (F.struct(*cell) if cell else F.struct(F.lit(0))).alias("cell"), F.col(a).alias("a"), F.col(b).alias("b"), "n")
        return named.select("task", "cell.*", "a", "b", "n").groupBy("task").applyInArrow(sign_sums, "s decimal(38,0)")

    wide = lambda c: c.cast("decimal(19,0)")
    pairs = lambda n: wide(n) * wide(n - 1) / 2
    parts = [signs([], "px", "py"), signs(["py"], "px", "y"), signs(["px"], "x", "py"), signs(["px", "py"], "x", "y")]
    s = reduce(DataFrame.unionByName, parts).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("s"))
    ties = {c: counts.groupBy(c).agg(F.sum("n").alias("t")) for c in ("x", "y")}
    tied = [ties[c].agg(F.coalesce(F.sum(pairs(F.col("t"))), F.lit(0)).cast("double").alias(f"t{c}")) for c in ("x", "y")]
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(pairs(F.col("n")).cast("double").alias("all"))
    one = s.crossJoin(tied[0]).crossJoin(tied[1]).crossJoin(whole)  # one row each
    return one.select(F.coalesce(F.try_divide("s", F.sqrt(F.col("all") - F.col("tx")) * F.sqrt(F.col("all") - F.col("ty"))), F.lit(0.0)).alias("tau"))


def top_share(df: DataFrame, column: str, top: float) -> DataFrame:
    """One row: what share of the column's total the rows above its (1 - top) quantile hold."""
    cut = quantiles(df, column, [1 - top]).select(F.col("quantiles")[0].alias("cut"))
    return df.crossJoin(F.broadcast(cut)).agg(F.first("cut").alias("cut"), F.round(F.sum(F.when(F.col(column) >= F.col("cut"), F.col(column))) / F.sum(column), 6).alias("share"))


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: n, mean, sd, percentiles 5/25/50/75/95, skewness and excess kurtosis (population)."""
    def of(c):
        q = F.first(f"_{c}")
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), *[q[i].alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))], F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))
    cuts = column_quantiles(df, columns, (0.05, 0.25, 0.5, 0.75, 0.95))
    return df.select(*columns).crossJoin(F.broadcast(cuts)).agg(F.array(*[of(c) for c in columns]).alias("x")).select(F.inline("x"))


def two_periods(df: DataFrame, dimension: str, value: str, first: Column, second: Column) -> DataFrame:
    """Per level: value in both periods, change, percent and share of the whole change, in one aggregate."""
    both = df.groupBy(dimension).agg(F.coalesce(F.sum(F.when(first, F.col(value))), F.lit(0.0)).alias("before"), F.coalesce(F.sum(F.when(second, F.col(value))), F.lit(0.0)).alias("after"))
    total = both.agg(F.sum(F.col("after") - F.col("before")).alias("total"))
    change = F.col("after") - F.col("before")
    return both.crossJoin(F.broadcast(total)).select(
        dimension, F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), F.round(change, 2).alias("change"),
        F.round(F.when(F.col("before") != 0, 100 * change / F.col("before")), 4).alias("pct"), F.round(100 * change / F.col("total"), 4).alias("share_of_change"),
    )
