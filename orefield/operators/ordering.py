"""Running sums, places and tiles over the order of a whole table, without one task that holds it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def _slot(column: Column, cuts: Column) -> Column:
    """Odd numbers are a cut itself, even ones what lies between two; null is -1."""
    inside = 2 * F.size(F.filter(cuts, lambda c: c < column)) + F.array_contains(cuts, column).cast("int")
    return F.when(column.isNull(), -1).otherwise(inside)


def _in_order(name: str, order: str) -> Column:
    return F.col(name).desc_nulls_last() if order.startswith("-") else F.col(name).asc_nulls_first()


def running(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], parts: int = 64, least: Mapping[str, Column] | None = None) -> DataFrame:
    """df with running sums, and running minima of what is in least, down to each row, itself included, in the order of the columns ("-name" falls; null comes before all numbers).

    Quantiles of the first two columns, numbers or times, deal the rows into slots. A value that many rows share is itself a
    quantile and is split further by the second column. Slots are summed apart, and only their totals, at most
    (2 parts + 2) ** 2 rows, are ordered together, so the quantiles needn't be exact. The order should tell all rows apart.
    """
    names = [o.removeprefix("-") for o in order]
    at = [i / parts for i in range(1, parts)]
    cuts = df.agg(*[F.array_distinct(F.percentile_approx(n, at)).alias(f"_c{i}") for i, n in enumerate(names[:2])])
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("_s0", _slot(F.col(names[0]), F.col("_c0")))
    second = F.when(F.pmod("_s0", F.lit(2)) == 1, _slot(F.col(names[1]), F.col("_c1"))).otherwise(0) if len(names) > 1 else F.lit(0)
    folds = {**{out: (value, F.sum) for out, value in sums.items()}, **{out: (value, F.min) for out, value in (least or {}).items()}}
    dealt = dealt.withColumn("_s1", second).withColumns({f"_v{i}": v for i, (v, _) in enumerate(folds.values())})
    above = Window.orderBy(*[_in_order(s, o) for s, o in zip(("_s0", "_s1"), order)]).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_s0", "_s1").agg(*[fold(f"_v{i}").alias(f"_t{i}") for i, (_, fold) in enumerate(folds.values())])
    before = totals.select("_s0", "_s1", *[fold(f"_t{i}").over(above).alias(f"_b{i}") for i, (_, fold) in enumerate(folds.values())])
    inside = Window.partitionBy("_s0", "_s1").orderBy(*[_in_order(n, o) for n, o in zip(names, order)]).rowsBetween(Window.unboundedPreceding, 0)

    def upto(i: int, fold) -> Column:
        here = fold(f"_v{i}").over(inside)
        return F.coalesce(F.col(f"_b{i}"), F.lit(0)) + here if fold is F.sum else F.least(F.col(f"_b{i}"), here)

    found = [upto(i, fold).alias(out) for i, (out, (_, fold)) in enumerate(folds.items())]
    return dealt.join(F.broadcast(before), ["_s0", "_s1"]).select(*df.columns, *found)


def placed(df: DataFrame, order: Sequence[str], out: str = "place") -> DataFrame:
    """df with the place of each row, from 1."""
    return running(df, order, {out: F.lit(1)})


def tiled(df: DataFrame, order: Sequence[str], n: int, out: str = "tile") -> DataFrame:
    """df with n tiles of even size, the first ones a row larger where rows don't come out even."""
    both = placed(df, order, "_r").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    size, r = F.floor(F.col("_n") / n), F.col("_r")
    edge = (F.col("_n") % n) * (size + 1)
    tile = F.when(r <= edge, F.ceil(r / (size + 1))).otherwise(F.col("_n") % n + F.ceil((r - edge) / F.greatest(size, F.lit(1))))
    return both.withColumn(out, tile.cast("int")).drop("_r", "_n")


def running_by_range(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """running for columns of any type that has an order, strings among them: a vocabulary, say.

    Spark deals the rows into ranges of even size and they are written as dealt; ranges are summed apart, and only their
    totals, a row for each task, are ordered together. The order should tell all rows apart.
    """
    dealt = written(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), **{f"_v{i}": v for i, v in enumerate(sums.values())}}), "ranges")
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_t{i}").over(above), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = [(F.col(f"_b{i}") + F.sum(f"_v{i}").over(inside)).alias(out) for i, out in enumerate(sums)]
    return dealt.join(F.broadcast(before), F.col("_part") == F.col("_of")).select(*df.columns, *upto)
