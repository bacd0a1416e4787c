"""Feature frames, transforms and decisions over trial tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import quantiles


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_lambda(df: DataFrame, column: str, grid: Sequence[float]) -> DataFrame:
    """lambda, likelihood: the profile log-likelihood of each lambda of the grid, all in one aggregate."""
    x = F.col(column)
    jacobian = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    rows = [F.struct(F.lit(float(g)).alias("lambda"), (-F.count(x) / 2 * F.ln(F.var_pop(yeo_johnson(x, g))) + (g - 1) * jacobian).alias("likelihood")) for g in grid]
    return df.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def skew_effect(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, skewness before and after log1p (values held at 0)."""
    rows = [F.struct(F.lit(c).alias("column"), F.skewness(c).alias("before"), F.skewness(F.log1p(F.greatest(F.col(c), F.lit(0.0)))).alias("after")) for c in columns]
    return df.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def noise_floor(trials: DataFrame, metric: str, baseline: Column, min_delta: float, z: float = 2.0) -> DataFrame:
    """Mean and deviation of the baseline's repeats and the least gain that counts: max(min_delta, z deviations)."""
    one = trials.filter(baseline).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sigma"), F.count("*").alias("n"))
    return one.withColumn("least_gain", F.greatest(F.lit(min_delta), z * F.col("sigma")))


def leaderboard(trials: DataFrame, key: Sequence[str], metric: str) -> DataFrame:
    """The best trial of each configuration, best first by place."""
    best = trials.groupBy(*key).agg(F.max(metric).alias("best"), F.avg(metric).alias("mean"), F.count("*").alias("n"))
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("best"), *key)))


def charter(candidates: DataFrame, criteria: Mapping[str, Column]) -> DataFrame:
    """Candidates with a pass column for each criterion and how many they fail."""
    out = candidates.withColumns({f"ok_{n}": F.coalesce(c, F.lit(False)) for n, c in criteria.items()})
    return out.withColumn("n_failed", sum((F.when(F.col(f"ok_{n}"), 0).otherwise(1) for n in criteria), F.lit(0)))


def impact_range(base: Column, low: float, mid: float, high: float) -> Column:
    return F.struct((base * low).alias("low"), (base * mid).alias("base"), (base * high).alias("high"))


def conformal(df: DataFrame, y: str, p: str, group: str, low: float, high: float) -> DataFrame:
    """group, lo, hi: residual quantiles per group of a calibration table."""
    off = quantiles(df.select(group, (F.col(y) - F.col(p)).alias("off")), "off", [low, high], [group])
    return off.select(group, F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))


def coverage(df: DataFrame, bounds: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """Share of rows whose y lies within the prediction plus its group's residual quantiles."""
    inside = F.col(y).between(F.col(p) + F.col("lo"), F.col(p) + F.col("hi"))
    return df.join(bounds, group).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("covered"))


def flags_by_cohort(df: DataFrame, cohort: str, rules: Mapping[str, Column]) -> DataFrame:
    """cohort, flag, n, flagged: one pass for all rules."""
    by = df.groupBy(cohort).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f) for f, c in rules.items()])
    return by.select(cohort, "n", F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("flagged")) for f in rules])))


def peak(df: DataFrame, group: str, at: str, score: str) -> DataFrame:
    return df.groupBy(group).agg(F.max_by(at, F.struct(score, at)).alias("peak"), F.max(score).alias("score"))


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with a 0/1 column c_missing for each of the columns."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def table_pipeline(categorical: Sequence[str], numeric: Sequence[str], out: str = "features"):
    """A pyspark.ml Pipeline: one-hot columns (levels by falling train frequency; unseen and null ones apart), numbers as they are.

    Fitted on train rows only it is a PipelineModel that can be saved, loaded and replayed on new rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    index, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False),
        VectorAssembler(inputCols=[*hot, *numeric], outputCol=out, handleInvalid="keep"),
    ])


def eigen_spectrum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """component, eigenvalue, share, cumulative share and kaiser (eigenvalue over 1) of the correlation matrix of few columns.

    One aggregate over the rows gives the matrix; only that comes to the driver.
    """
    import numpy as np

    from .clusters import table_of

    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    r = df.agg(*[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    m = np.eye(len(columns))
    for i, j in pairs:
        m[i, j] = m[j, i] = r[f"r{i}_{j}"] or 0.0
    values = np.sort(np.linalg.eigvalsh(m))[::-1].clip(0)
    share = values / values.sum()
    return table_of(df, [{"component": i + 1, "eigenvalue": float(v), "share": float(share[i]), "cumulative": float(share[: i + 1].sum()), "kaiser": bool(v > 1)} for i, v in enumerate(values)])


def calibration_gap(df: DataFrame, group: str, y: str = "y", score: str = "score", least: int = 1) -> DataFrame:
    """group, n, mean score, rate and their difference, of groups of so many rows at least."""
    by = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("rate")).filter(F.col("n") >= least)
    return by.withColumn("gap", F.col("mean_score") - F.col("rate"))


def reference_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, mean, std, lowest and highest: what a deployed scorer keeps of its training rows."""
    stats = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("lowest"), F.max(c).cast("double").alias("highest")) for c in columns])
    return df.agg(stats.alias("s")).select(F.inline("s"))


def encoding_inflation(encoded: DataFrame, y: str, in_fold: str, out_of_fold: str) -> DataFrame:
    """Correlation of the target with an encoding that has seen it, with one that hasn't, and the difference: the leak."""
    out = encoded.agg(F.corr(y, in_fold).alias("in_fold"), F.corr(y, out_of_fold).alias("out_of_fold"))
    return out.withColumn("inflation", F.col("in_fold") - F.col("out_of_fold"))
