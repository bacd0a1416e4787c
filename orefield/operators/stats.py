"""Tests and intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .ordering import running
from .sampling import hash_order


def benjamini_hochberg(df: DataFrame, p: str, n_tests: int | None = None) -> DataFrame:
    """df with q: p n / rank, and the least of those of all larger p; equal p have the last of their ranks, and a null p has no q.

    Ranks and the minimum from above run over the distinct p in slots, so no task orders all tests. The table of tests is written, as
    it is read several times.
    """
    df = written(df, "tests")
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranks = running(counts, ["_p"], {"_rank": F.col("_n")})
    n = F.lit(float(n_tests)) if n_tests else F.col("_all")
    raw = ranks.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).withColumn("_raw", F.col("_p") * n / F.col("_rank"))
    q = running(written(raw.select("_p", "_raw"), "ranks"), ["-_p"], {}, least={"_q": F.col("_raw")}).select("_p", F.least("_q", F.lit(1.0)).alias("q"))
    return df.join(q, F.col(p) == F.col("_p"), "left").drop("_p")


def bonferroni(df: DataFrame, p: str, n_tests: int | None = None) -> DataFrame:
    n = F.lit(float(n_tests)) if n_tests else F.count("*").over(Window.partitionBy())
    return df.withColumn("q", F.least(F.col(p) * n, F.lit(1.0)))


def corrected(df: DataFrame, p: str, method: str, n_tests: int | None = None) -> DataFrame:
    if method == "none":
        return df.withColumn("q", F.col(p))
    return {"bh": benjamini_hochberg, "bonferroni": bonferroni}[method](df, p, n_tests)


def two_sided_p(z: Column) -> Column:
    """P of a standard normal at least as far from 0; Spark has no erfc, so a vectorised function of a result table."""
    def erfc(x: pd.Series) -> pd.Series:
        return x.map(math.erfc, na_action="ignore")

    return F.pandas_udf(erfc, "double")(F.abs(z) / math.sqrt(2.0))


def two_proportions(df: DataFrame, arm: str, success: str, control: str, treated: str) -> DataFrame:
    """One row: n and rate of both arms, lift, z by the pooled variance, and the 95 % interval of the difference by the unpooled."""
    def of(a):
        return F.count_if(F.col(arm) == a), F.avg(F.when(F.col(arm) == a, F.col(success).cast("double")))
    (n0, p0), (n1, p1) = of(control), of(treated)
    one = df.agg(n0.alias("n0"), n1.alias("n1"), p0.alias("p0"), p1.alias("p1"))
    pooled = (F.col("p0") * F.col("n0") + F.col("p1") * F.col("n1")) / (F.col("n0") + F.col("n1"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n0") + 1 / F.col("n1")))
    own = F.sqrt(F.col("p0") * (1 - F.col("p0")) / F.col("n0") + F.col("p1") * (1 - F.col("p1")) / F.col("n1"))
    diff = F.col("p1") - F.col("p0")
    return one.select("n0", "n1", "p0", "p1", (diff / F.col("p0")).alias("lift"), (diff / se).alias("z"), (diff - 1.959964 * own).alias("low"), (diff + 1.959964 * own).alias("high"))


def sample_ratio(df: DataFrame, arm: str, control: str, treated: str, share: float = 0.5) -> DataFrame:
    """Chi-square of the arms' sizes against the planned share, with its p by the normal tail."""
    one = df.agg(F.count_if(F.col(arm) == control).alias("n0"), F.count_if(F.col(arm) == treated).alias("n1"))
    n = F.col("n0") + F.col("n1")
    chi = (F.col("n1") - n * share) ** 2 / (n * share) + (F.col("n0") - n * (1 - share)) ** 2 / (n * (1 - share))
    return one.select("n0", "n1", chi.alias("chi_square"), two_sided_p(F.sqrt(chi)).alias("p"))


#: Cumulative Poisson(1) probabilities of 0, 1, 2, ...
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def poisson_weight(group: str, replicate: str, seed: int) -> Column:
    """A Poisson(1) number that depends on group, replicate and seed only."""
    u = F.pmod(F.xxhash64(F.lit(seed), group, replicate), F.lit(1 << 30)) / float(1 << 30)
    weight = F.lit(0)
    for c in _POISSON:
        weight = weight + (u >= c).cast("int")
    return weight


def group_bootstrap(df: DataFrame, group: str, sums: dict[str, Column], metric: Column, replicates: int = 200, seed: int = 7) -> DataFrame:
    """replicate and metric, where metric is an expression of weighted sums. Rows are summed per group before groups are repeated."""
    per_group = df.groupBy(group).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    drawn = per_group.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", poisson_weight(group, "replicate", seed))
    return drawn.groupBy("replicate").agg(*[F.sum(F.col(n) * F.col("_w")).alias(n) for n in sums]).select("replicate", metric.alias("metric"))


def interval(replicates: DataFrame, column: str = "metric", level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return replicates.agg(F.percentile(column, F.lit(tail)).alias("low"), F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(1 - tail)).alias("high"))


def paired_contrast(df: DataFrame, group: str, a: str, b: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Mean of b - a with its bootstrap interval over groups and the share of replicates in which b is better (smaller)."""
    reps = group_bootstrap(df, group, {"s": F.col(b) - F.col(a), "n": F.lit(1)}, F.col("s") / F.col("n"), replicates, seed)
    mean = df.agg(F.avg(F.col(b) - F.col(a)).alias("mean"))
    better = reps.agg(F.avg((F.col("metric") < 0).cast("double")).alias("b_better"))
    return mean.crossJoin(interval(reps)).crossJoin(better)


def sign_flip(df: DataFrame, group: str, delta: str, replicates: int = 999, seed: int = 7) -> DataFrame:
    """One row: mean of the groups' mean delta and the share of random sign flips (+1) with as large a mean."""
    groups = df.groupBy(group).agg(F.avg(delta).alias("d"))
    sign = 1 - 2 * F.pmod(F.xxhash64(F.lit(seed), group, "replicate"), F.lit(2))
    flips = groups.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).groupBy("replicate").agg(F.avg(F.col("d") * sign).alias("m"))
    seen = groups.agg(F.avg("d").alias("mean"), F.count("*").alias("groups"))
    return flips.crossJoin(F.broadcast(seen)).agg(F.first("mean").alias("mean"), F.first("groups").alias("groups"), ((F.count_if(F.abs("m") >= F.abs("mean")) + 1) / (F.count("*") + 1)).alias("p"))


def group_balanced(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Rows with weight 1 / size of their group."""
    sizes = df.groupBy(group).agg((1 / F.count("*")).alias("weight"))
    return df.select(group, *columns).na.drop().join(sizes, group)


def weighted_correlations(df: DataFrame, columns: Sequence[str], weight: str = "weight") -> DataFrame:
    """a, b, r of weighted Pearson correlations, in one aggregate."""
    w = F.col(weight)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def r(a, b):
        x, y, n = F.col(a), F.col(b), F.sum(w)
        cov = F.sum(w * x * y) / n - F.sum(w * x) * F.sum(w * y) / n / n
        var = lambda z: F.sum(w * z * z) / n - (F.sum(w * z) / n) ** 2
        return cov / F.sqrt(var(x) * var(y))

    return df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs]).alias("x")).select(F.inline("x"))


def vif(df: DataFrame, columns: Sequence[str], weight: str = "weight") -> DataFrame:
    """Variance inflation: the diagonal of the inverse of the (small) weighted correlation matrix."""
    import numpy as np

    m = np.eye(len(columns))
    for row in weighted_correlations(df, columns, weight).collect():
        i, j = columns.index(row.a), columns.index(row.b)
        m[i, j] = m[j, i] = row.r
    diagonal = np.linalg.pinv(m).diagonal().tolist()
    rows = [F.struct(F.lit(c).alias("column"), F.lit(v).alias("vif")) for c, v in zip(columns, diagonal)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def permuted(df: DataFrame, column: str, stratum: str, key: str, seed: int = 7) -> DataFrame:
    """df with the column's values shuffled within each stratum, in hash order."""
    w = Window.partitionBy(stratum)
    left = df.withColumn("_i", F.row_number().over(w.orderBy(key)))
    right = df.select(F.col(stratum), F.col(column).alias("_v"), F.row_number().over(w.orderBy(hash_order(key, seed), key)).alias("_i"))
    return left.join(right, [stratum, "_i"]).withColumn(column, F.col("_v")).drop("_i", "_v").select(df.columns)


def rate_intervals(df: DataFrame, group: str, category: str, success: str, replicates: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """category, rate, low and high of its bootstrap over groups, difference to the overall rate, and the share of replicates in which it is highest."""
    sums = df.groupBy(group, category).agg(F.sum(success).alias("s"), F.count(success).alias("n"))
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(group, "replicate", seed))
    rates = drawn.groupBy("replicate", category).agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("r"))
    best = rates.groupBy("replicate").agg(F.max("r").alias("best"))
    tail = (1 - level) / 2
    out = rates.join(best, "replicate").groupBy(category).agg(
        F.percentile("r", F.lit(tail)).alias("low"), F.percentile("r", F.lit(1 - tail)).alias("high"), F.avg((F.col("r") == F.col("best")).cast("int")).alias("highest")
    )
    own = sums.groupBy(category).agg((F.sum("s") / F.sum("n")).alias("rate"))
    overall = sums.agg((F.sum("s") / F.sum("n")).alias("overall"))
    return own.join(out, category).crossJoin(overall).select(category, "rate", "low", "high", (F.col("rate") - F.col("overall")).alias("difference"), "highest")  # one row
