"""Searches over segmentations: one space to judge all of them, an objective with constraints, finalists, personas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clusters import build, table_of
from .evaluation import agreement, cluster_indices
from .sampling import hash_share

#: Shares of the three indices in the objective.
WEIGHTS = {"silhouette": 0.50, "davies_bouldin": 0.30, "calinski_harabasz": 0.20}


def reference_space(df: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """All columns, standardised, as a vector called reference: fitted once, and the same for every candidate."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="reference", withMean=True)]).fit(df)


def trials(df: DataFrame, candidates: Sequence[tuple[str, int, int]], seed: int = 7) -> DataFrame:
    """One row a candidate (algorithm, k, dims): its labels' indices in the reference space, its silhouette in its own space, its shape.

    df has a vector reference; candidates cluster in its first dims principal components. The loop runs over candidates.
    """
    judge, rows = ClusteringEvaluator(), []
    df = df.select("reference").persist()
    width = len(df.first().reference)
    names = [f"x{i}" for i in range(width)]
    for number, (algorithm, k, dims) in enumerate(candidates):
        own = df.withColumn("own", F.col("reference")) if dims >= width else PCA(k=dims, inputCol="reference", outputCol="own").fit(df).transform(df)
        labelled = build(algorithm, k, seed).setFeaturesCol("own").fit(own).transform(own).select("reference", "own", "prediction").persist()
        sizes = labelled.groupBy("prediction").agg(F.count("*").alias("n"))
        p = F.col("n") / F.col("all")
        shape = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all")))).agg(F.count("*").alias("found"), F.min(p).alias("least"), F.max(p).alias("most"), F.when(F.count("*") > 1, -F.sum(p * F.ln(p)) / F.ln(F.greatest(F.count("*"), F.lit(2)))).alias("entropy")).first()
        scored = {"silhouette": None, "own_silhouette": None, "davies_bouldin": None, "calinski_harabasz": None}
        if shape.found > 1:
            flat = labelled.withColumn("a", vector_to_array("reference")).select("prediction", *[F.col("a")[i].alias(c) for i, c in enumerate(names)])
            indices = cluster_indices(flat, names, "prediction").first()
            by = {c: float(judge.setFeaturesCol(c).evaluate(labelled)) for c in ("reference", "own")}
            scored = {"silhouette": by["reference"], "own_silhouette": by["own"], "davies_bouldin": float(indices.davies_bouldin), "calinski_harabasz": float(indices.calinski_harabasz)}
        rows.append({"number": number, "algorithm": algorithm, "k": k, "dims": dims, "found": shape.found, "least": float(shape.least), "most": float(shape.most), "entropy": float(shape.entropy or 0.0), **scored})
        labelled.unpersist()
    df.unpersist()
    return table_of(df, rows)


def frozen_scale(table: DataFrame) -> float:
    """The constant for the Calinski-Harabasz index: the median of calibration trials, at least 1; 500 where none has the index."""
    return float(table.agg(F.greatest(F.coalesce(F.percentile("calinski_harabasz", F.lit(0.5)), F.lit(500.0)), F.lit(1.0))).first()[0])


def objective(table: DataFrame, kappa: float, *, least: float = 0.03, most: float = 0.60, least_k: int = 3, balance: float = 0.55, noise: float = 0.35) -> DataFrame:
    """Trials with raw (weighted indices on 0 to 1), penalty, feasible and objective. A trial that breaks a constraint is below all that don't.

    The Calinski-Harabasz index c counts as c / (c + kappa); kappa stays the same for a whole study, so that its objectives compare.
    Without two segments a trial gets -1. A column noise, the share of rows without a segment, is read where there is one.
    """
    out_of = F.col("noise") if "noise" in table.columns else F.lit(0.0)
    unit = {"silhouette": (F.col("silhouette") + 1) / 2, "davies_bouldin": 1 / (1 + F.col("davies_bouldin")), "calinski_harabasz": F.col("calinski_harabasz") / (F.col("calinski_harabasz") + kappa)}
    broken = [
        (F.col("least") < least, 0.35 * (least - F.col("least")) / least),
        (F.col("most") > most, 0.30 * (F.col("most") - most) / (1 - most)),
        (out_of > noise, 0.5 * (out_of - noise)),
        (F.col("found") < least_k, 0.08 * (least_k - F.col("found"))),
        ((F.col("entropy") < balance) & (F.col("found") > 2), 0.10 * (balance - F.col("entropy"))),
    ]
    penalty, fits = F.lit(0.0), F.lit(True)
    for condition, cost in broken:
        penalty, fits = penalty + F.when(condition, cost).otherwise(0.0), fits & ~condition
    judged = (F.col("found") > 1) & F.col("silhouette").isNotNull()
    out = table.withColumns({"raw": F.when(judged, sum((w * unit[c] for c, w in WEIGHTS.items()), F.lit(0.0))).otherwise(0.0), "penalty": F.when(judged, penalty).otherwise(1.0), "feasible": judged & fits})
    return out.withColumn("objective", F.when(judged, F.col("raw") - F.col("penalty") - F.when(F.col("feasible"), 0.0).otherwise(1.0)).otherwise(-1.0))


def anytime(scored: DataFrame) -> DataFrame:
    """Trials (a small table) with the best objective so far and their place."""
    so_far = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("best_so_far", F.max("objective").over(so_far)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("objective"), "number")))


def optimism(table: DataFrame) -> DataFrame:
    """dims, n, mean and largest excess of the silhouette in the candidate's own space over that in the reference space, share of it above 0.05."""
    excess = F.col("own_silhouette") - F.col("silhouette")
    return table.filter(excess.isNotNull()).groupBy("dims").agg(F.count("*").alias("n"), F.avg(excess).alias("mean"), F.max(excess).alias("most"), F.avg((excess > 0.05).cast("double")).alias("inflated"))


def finalists(df: DataFrame, key: str, candidates: Sequence[tuple[str, int, int]], top: int, share: float = 0.3, seed: int = 7) -> DataFrame:
    """Candidates are searched on a seeded share of df (with a vector reference); the best top are fitted again on all rows.

    number, search and full objective and place, feasible on all rows, champion: the best that is feasible there, else the best.
    """
    searched = trials(df.filter(hash_share(key, seed) < share), candidates, seed)
    kappa = frozen_scale(searched)
    found = anytime(objective(searched, kappa)).filter(F.col("place") <= top).orderBy("place").collect()
    again = objective(trials(df, [candidates[r.number] for r in found], seed), kappa)
    first = table_of(df, [{"number": i, "candidate": r.number, "search_place": r.place, "search_objective": r.objective} for i, r in enumerate(found)])
    both = again.join(F.broadcast(first), "number").withColumn("change", F.col("objective") - F.col("search_objective"))
    best = Window.orderBy(F.desc("feasible"), F.desc("objective"), "search_place")
    return both.withColumn("champion", F.row_number().over(best) == 1).drop("number").withColumnRenamed("candidate", "number")


def chosen_within_one_error(scores: DataFrame, config: str, size: str) -> DataFrame:
    """Per configuration: mean of its fold scores, standard error, best, chosen (the smallest within one error of the best)."""
    by = scores.groupBy(config, size).agg(F.avg("score").alias("mean"), (F.stddev_samp("score") / F.sqrt(F.count("score"))).alias("error"), F.count("score").alias("folds"))
    top = by.agg(F.max_by(F.struct("mean", "error", config), F.struct("mean", F.col(config))).alias("_t"))
    near = by.crossJoin(F.broadcast(top)).withColumn("_near", F.col("mean") >= F.col("_t.mean") - F.coalesce("_t.error", F.lit(0.0)))
    small = near.filter("_near").agg(F.min_by(config, F.struct(F.col(size), F.col(config))).alias("_c"))
    return near.crossJoin(F.broadcast(small)).select(config, size, "mean", "error", "folds", (F.col(config) == F.col(f"_t.{config}")).alias("best"), (F.col(config) == F.col("_c")).alias("chosen"))


def personas(axes: DataFrame, segment: str, names: Sequence[str], archetypes: Mapping[str, Column]) -> DataFrame:
    """segment, persona, fit: each segment gets one archetype and no archetype serves two. axes: one row a segment.

    The best pair of all goes first, then the best of what is left (ties: smaller segment, then archetypes in order); segments
    beyond the archetypes are named by the axis farthest from 0. The fits of segments and archetypes, few rows, are one array.
    """
    every = F.array(*[F.struct(f.cast("double").alias("fit"), F.lit(i).alias("i"), F.lit(n).alias("persona")) for i, (n, f) in enumerate(archetypes.items())])
    pairs = axes.select(F.col(segment).alias("segment"), F.inline(every)).select(F.struct((-F.col("fit")).alias("worse"), "segment", "i", "persona", "fit").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    taken = lambda done, x: F.exists(done, lambda y: (y["segment"] == x["segment"]) | (y["i"] == x["i"]))
    greedy = F.aggregate("x", F.slice("x", 1, 0), lambda done, x: F.when(taken(done, x), done).otherwise(F.concat(done, F.array(x))))
    given = pairs.select(F.inline(greedy)).select(F.col("segment").alias(segment), "persona", "fit")
    far = F.array_max(F.array(*[F.struct(F.abs(n).alias("far"), F.lit(n).alias("axis"), F.col(n).cast("double").alias("value")) for n in names]))
    own = F.concat(F.when(far["value"] > 0, "high ").otherwise("low "), far["axis"])
    out = axes.join(F.broadcast(given), segment, "left")
    return out.select(segment, F.coalesce("persona", own).alias("persona"), F.coalesce("fit", far["value"]).alias("fit"))


def tree_leaves(df: DataFrame, label: str, depth: int = 4) -> DataFrame:
    """leaf, segment, n, purity of a shallow tree on features that imitates the labels."""
    numbered = df.withColumn("label", F.col(label).cast("double"))
    model = DecisionTreeClassifier(maxDepth=depth, seed=7, leafCol="leaf").fit(numbered)
    same = (F.col("prediction") == F.col("label")).cast("double")
    return model.transform(numbered).groupBy(F.col("leaf").cast("int").alias("leaf"), F.col("prediction").cast("int").alias("segment")).agg(F.count("*").alias("n"), F.avg(same).alias("purity"))


def outlier_sensitivity(df: DataFrame, key: str, outlier: Column, k: int, seed: int = 7) -> DataFrame:
    """removed, kept, ari, nmi: labels of the rows that stay, from a fit with the outliers against a fit without them. df: key, features."""
    marked = df.withColumn("_out", F.coalesce(outlier, F.lit(False))).persist()
    stay = marked.filter(~F.col("_out"))
    label = lambda fit_on, name: KMeans(k=k, seed=seed, maxIter=10).fit(fit_on).transform(stay).select(key, F.col("prediction").alias(name))
    counts = marked.agg(F.count_if("_out").alias("removed"), F.count_if(~F.col("_out")).alias("kept"))
    return counts.crossJoin(agreement(label(marked, "a").join(label(stay, "b"), key), "a", "b"))


def zones(df: DataFrame, start: Sequence[str], end: Sequence[str], k: int, seed: int = 7) -> DataFrame:
    """df with the zones of two points, from one k-means over all of both, and whether they are the same."""
    point = lambda names: VectorAssembler(inputCols=list(names), outputCol="features")
    both = point(start).transform(df).select("features").unionByName(point(end).transform(df).select("features"))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(both)
    out = df
    for names, zone in ((start, "start_zone"), (end, "end_zone")):
        out = model.transform(point(names).transform(out)).withColumnRenamed("prediction", zone).drop("features")
    return out.withColumn("same_zone", F.col("start_zone") == F.col("end_zone"))
