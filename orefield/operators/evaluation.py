"""Scores of predictions, drift, calibration, clusters. Predictions are columns y (0/1 or number) and score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import average_rank
from .ordering import running
from .quantiles import column_quantiles, quantiles


def regression_scores(df: DataFrame, y: str = "y", p: str = "p", within: float = 120.0) -> DataFrame:
    """RMSLE (predictions held at 0), MAE, median error, RMSE, R2 and the share within a bound: one aggregate, and an exact median beside it."""
    e, held = F.col(p) - F.col(y), F.greatest(F.col(p), F.lit(0.0))
    middle = quantiles(df.select(F.abs(e).alias("e")), "e", [0.5]).agg(F.first(F.col("quantiles")[0]).alias("medae"))
    one = df.agg(
        F.sqrt(F.avg((F.log1p(held) - F.log1p(y)) ** 2)).alias("rmsle"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"), F.avg((F.abs(e) <= within).cast("double")).alias("within"),
    )
    return one.crossJoin(middle).select("rmsle", "mae", "medae", "rmse", "r2", "within")  # one row each


def r_squared(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: R2 as in regression_scores, by one aggregate alone."""
    e = F.col(p) - F.col(y)
    return df.agg((1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))


def class_scores(y: Column, score: Column, threshold: float = 0.5) -> list[Column]:
    """Confusion counts, precision, recall, F1, accuracy, MCC, log loss and Brier score as aggregates."""
    hit, pos = score >= threshold, y == 1
    tp, fp, fn, tn = F.count_if(hit & pos), F.count_if(hit & ~pos), F.count_if(~hit & pos), F.count_if(~hit & ~pos)
    held = F.least(F.greatest(score, F.lit(1e-15)), F.lit(1 - 1e-15))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((tp + tn) / F.count("*")).alias("accuracy"), ratio(tp * tn - fp * fn, F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        F.avg(-F.when(pos, F.ln(held)).otherwise(F.ln(1 - held))).alias("log_loss"), F.avg((score - y) ** 2).alias("brier"),
    ]


def curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Per distinct score, from the highest: hits and misses at it and down to it. Rows of one score are one point."""
    by = df.groupBy(score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return running(by, [f"-{score}"], {"tp": F.col("pos"), "fp": F.col("neg")})


def auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """roc_auc by rank sums and pr_auc as average precision; ties count as one step."""
    total = df.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    c = curve(df, y, score).crossJoin(F.broadcast(total))
    roc = F.sum((F.col("tp") - F.col("pos") / 2) * F.col("neg")) / F.first(F.col("p") * F.col("n"))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("p")
    return c.agg(roc.alias("roc_auc"), ap.alias("pr_auc"))


def best_threshold(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The score with the highest F1; of equal ones the higher score."""
    total = df.agg(F.count_if(F.col(y) == 1).alias("p"))
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")), 12)
    return curve(df, y, score).crossJoin(F.broadcast(total)).agg(F.max_by(score, F.struct(f1.alias("f"), score)).alias("threshold"), F.max(f1).alias("f1"))


def calibration(df: DataFrame, bins: int, y: str = "y", score: str = "score") -> DataFrame:
    """bin, n, mean score, rate, by equal-width bins of the score."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def _under(column: str):
    return lambda edge: edge < F.col(column)


def quantile_cuts(expected: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """One row: for each column, under its name after "_", the distinct inner edges of the table's quantile bins."""
    edges = column_quantiles(expected, columns, [i / bins for i in range(1, bins)])
    return edges.select(*[F.array_distinct(f"_{c}").alias(f"_{c}") for c in columns])


def bin_counts(df: DataFrame, cuts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, bin, n: how many rows lie in each bin of the cuts."""
    rows = df.select(*columns).crossJoin(F.broadcast(cuts))  # one row
    at = [F.struct(F.lit(c).alias("column"), F.size(F.filter(F.col(f"_{c}"), _under(c))).alias("bin")) for c in columns]
    return rows.select(F.inline(F.array(*at))).groupBy("column", "bin").agg(F.count("*").alias("n"))


def stability(expected: DataFrame, actual: DataFrame, eps: float = 1e-4) -> DataFrame:
    """column, psi of two tables of bin counts; a share is at least eps."""
    def shares(counts: DataFrame, name: str) -> DataFrame:
        total = counts.groupBy("column").agg(F.sum("n").alias("t"))
        return counts.join(total, "column").select("column", "bin", (F.col("n") / F.col("t")).alias(name))

    both = shares(expected, "e").join(shares(actual, "a"), ["column", "bin"], "full_outer")
    e, a = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(eps)), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(eps))
    return both.groupBy("column").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def population_stability(expected: DataFrame, actual: DataFrame, columns: Sequence[str], bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """column, psi: shares by the expected table's quantile bins. Both tables are read once each for all columns."""
    cuts = quantile_cuts(expected, columns, bins)
    return stability(bin_counts(expected, cuts, columns), bin_counts(actual, cuts, columns), eps)


def mean_drift(reference: DataFrame, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, z of the batch's mean against the reference's mean and deviation."""
    a = reference.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    b = batch.agg(*[F.avg(c).alias(f"b_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), ((F.col(f"b_{c}") - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias("z")) for c in columns]
    return a.crossJoin(b).select(F.inline(F.array(*rows)))


def target_encoding(df: DataFrame, column: str, y: str, fold: str, smoothing: float = 10.0) -> DataFrame:
    """df with the mean of y of the same level in the other folds, drawn to their overall mean; levels they don't have get that."""
    level = df.groupBy(column, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    w = Window.partitionBy(column)
    other = level.select(column, fold, (F.sum("s").over(w) - F.col("s")).alias("os"), (F.sum("n").over(w) - F.col("n")).alias("on"))
    folds = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    all_ = Window.partitionBy()
    prior = folds.select(fold, ((F.sum("s").over(all_) - F.col("s")) / (F.sum("n").over(all_) - F.col("n"))).alias("prior"))
    joined = df.join(other, [column, fold]).join(F.broadcast(prior), fold)
    return joined.withColumn("encoded", (F.col("os") + smoothing * F.col("prior")) / (F.col("on") + smoothing)).drop("os", "on", "prior")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """adjusted Rand index and normalised mutual information of two labelings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda x: x * (x - 1) / 2.0
    rows = cells.groupBy(a).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum(pairs(F.col("n"))).alias("same"), F.sum("n").alias("all"))
    margins = rows.agg(F.sum(pairs(F.col("r"))).alias("sr")).crossJoin(cols.agg(F.sum(pairs(F.col("c"))).alias("sc"))).crossJoin(total)
    chance = F.col("sr") * F.col("sc") / pairs(F.col("all"))
    ari = (F.col("same") - chance) / ((F.col("sr") + F.col("sc")) / 2 - chance)
    joint = cells.join(rows, a).join(cols, b).crossJoin(F.broadcast(total.select("all")))
    mi = joint.agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("r") * F.col("c")))).alias("mi"))
    h = lambda t, c: t.crossJoin(F.broadcast(total.select("all"))).agg((-F.sum(F.col(c) / F.col("all") * F.ln(F.col(c) / F.col("all")))).alias(f"h{c}"))
    return margins.select(ari.alias("ari")).crossJoin(mi.crossJoin(h(rows, "r")).crossJoin(h(cols, "c")).select((2 * F.col("mi") / (F.col("hr") + F.col("hc"))).alias("nmi")))


def cluster_indices(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin of a labeling, by two aggregates; only the k centroids meet each other."""
    centre = df.groupBy(label).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"m_{c}") for c in columns])
    whole = df.agg(*[F.avg(c).alias(f"g_{c}") for c in columns])
    squared = sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in columns), F.lit(0.0))
    spread = df.join(F.broadcast(centre), label).groupBy(label).agg(F.sum(squared).alias("within"), F.avg(F.sqrt(squared)).alias("s"))
    k = centre.join(spread, label).crossJoin(F.broadcast(whole))
    between = sum(((F.col(f"m_{c}") - F.col(f"g_{c}")) ** 2 for c in columns), F.lit(0.0)) * F.col("_n")
    n, g = F.sum("_n"), F.count("*")
    ch = k.agg((F.sum(between) / (g - 1) / (F.sum("within") / (n - g))).alias("calinski_harabasz"))
    one = k.select(F.col(label).alias("a"), F.col("s").alias("sa"), *[F.col(f"m_{c}").alias(f"a_{c}") for c in columns])
    two = k.select(F.col(label).alias("b"), F.col("s").alias("sb"), *[F.col(f"m_{c}").alias(f"b_{c}") for c in columns])
    apart = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in columns), F.lit(0.0)))
    db = one.join(two, F.col("a") != F.col("b")).groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / apart).alias("d")).agg(F.avg("d").alias("davies_bouldin"))
    return ch.crossJoin(db)


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population deviation."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).select(df.columns)


def imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median in place of nulls, with a flag column for each."""
    medians = column_quantiles(df, columns, [0.5]).select(*[F.col(f"_{c}")[0].alias(f"_{c}") for c in columns])
    both = df.crossJoin(F.broadcast(medians))
    return both.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in columns}).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def winsorised(df: DataFrame, columns: Sequence[str], low: float, high: float) -> DataFrame:
    bounds = column_quantiles(df, columns, [low, high])
    return df.crossJoin(F.broadcast(bounds)).withColumns({c: F.least(F.greatest(F.col(c), F.col(f"_{c}")[0]), F.col(f"_{c}")[1]) for c in columns}).drop(*[f"_{c}" for c in columns])


def segment_profile(df: DataFrame, segment: str, columns: Sequence[str]) -> DataFrame:
    """segment, column, mean, z against the whole table, place by absolute z."""
    whole = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    by = df.groupBy(segment).agg(*[F.avg(c).alias(c) for c in columns]).crossJoin(F.broadcast(whole))
    long = by.select(segment, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mean"), ((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias("z")) for c in columns])))
    return long.withColumn("place", F.row_number().over(Window.partitionBy(segment).orderBy(F.desc(F.abs("z")), "column")))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df.select(a, b).na.drop(), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"))
