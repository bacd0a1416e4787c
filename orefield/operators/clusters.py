"""Studies over pyspark.ml clusterers: sweeps, stability, gap, surrogate rules. Loops run over candidates, never over rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .blocks import label_sums, met
from .evaluation import agreement
from .sampling import hash_share

ALGORITHMS: dict[str, Callable] = {
    "kmeans": lambda k, seed: KMeans(k=k, seed=seed, maxIter=10),
    "bisecting": lambda k, seed: BisectingKMeans(k=k, seed=seed, maxIter=10),
    "mixture": lambda k, seed: GaussianMixture(k=k, seed=seed, maxIter=10),
}


def build(name: str, k: int, seed: int = 7):
    return ALGORITHMS[name](k, seed)


def table_of(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """A small result table made of literals."""
    return df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])))


def sweep(df: DataFrame, ks: Sequence[int], name: str = "kmeans", seed: int = 7) -> DataFrame:
    """k asked for, k achieved, squared-Euclid silhouette. df: features (vector)."""
    judge, rows = ClusteringEvaluator(), []
    for k in ks:
        out = build(name, k, seed).fit(df).transform(df)
        rows.append({"k": k, "achieved": out.select("prediction").distinct().count(), "silhouette": float(judge.evaluate(out))})
    return table_of(df, rows)


def shootout(df: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """algorithm, silhouette, smallest and largest cluster's share."""
    judge, rows = ClusteringEvaluator(), []
    for name in ALGORITHMS:
        out = build(name, k, seed).fit(df).transform(df)
        shares = out.groupBy("prediction").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n"), F.sum("n")).first()
        rows.append({"algorithm": name, "silhouette": float(judge.evaluate(out)), "least": shares[0] / shares[2], "most": shares[1] / shares[2]})
    return table_of(df, rows)


def stability(df: DataFrame, key: str, k: int, repeats: int, share: float = 0.7, seed: int = 7) -> DataFrame:
    """repeat, ari, nmi: labelings of all rows by fits on seeded samples against the fit on all."""
    whole = KMeans(k=k, seed=seed, maxIter=10).fit(df).transform(df).select(key, F.col("prediction").alias("a"))
    rows = []
    for r in range(repeats):
        model = KMeans(k=k, seed=seed + r + 1, maxIter=10).fit(df.filter(hash_share(key, seed + r) < share))
        again = model.transform(df).select(key, F.col("prediction").alias("b"))
        one = agreement(whole.join(again, key), "a", "b").first()
        rows.append({"repeat": r, "ari": float(one.ari), "nmi": float(one.nmi)})
    return table_of(df, rows)


def gap_statistic(df: DataFrame, ks: Sequence[int], references: int = 3, seed: int = 7) -> DataFrame:
    """k, gap: mean log cost on uniform boxes of the data's ranges less log cost on the data."""
    import math

    from pyspark.ml.functions import array_to_vector

    arrays = df.select(vector_to_array("features").alias("v"))
    d = arrays.select(F.max(F.size("v"))).first()[0]
    box = arrays.agg(*[F.min(F.col("v")[i]).alias(f"lo{i}") for i in range(d)], *[F.max(F.col("v")[i]).alias(f"hi{i}") for i in range(d)])
    cost = lambda x, k: math.log(KMeans(k=k, seed=seed, maxIter=10).fit(x).summary.trainingCost + 1e-12)
    uniform = []
    for r in range(references):
        rows = arrays.crossJoin(F.broadcast(box)).select(F.array(*[F.col(f"lo{i}") + F.rand(seed + 31 * r + i) * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in range(d)]).alias("v"))
        uniform.append(rows.select(array_to_vector("v").alias("features")))
    return table_of(df, [{"k": k, "gap": sum(cost(u, k) for u in uniform) / references - cost(df, k)} for k in ks])


def surrogate(df: DataFrame, label: str, depth: int = 4) -> tuple[str, DataFrame]:
    """(rules, fidelity per label): a shallow tree that imitates the labels."""
    numbered = df.withColumn("label", F.col(label).cast("double"))
    model = DecisionTreeClassifier(maxDepth=depth, seed=7).fit(numbered)
    same = (F.col("prediction") == F.col("label")).cast("double")
    return model.toDebugString, model.transform(numbered).groupBy(label).agg(F.count("*").alias("n"), F.avg(same).alias("recall"))


def _distance(columns: Sequence[str], a: str, b: str):
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in columns), F.lit(0.0)))


def silhouette_profile(df: DataFrame, sample: DataFrame, key: str, label: str, columns: Sequence[str]) -> DataFrame:
    """label, n, mean silhouette and share of negative ones of the sampled rows, each against all rows of another key.

    Equal points of a label count as one with a weight, and distances are added up block against block: a pair of rows is
    never a row. Rows without a label, or with a coordinate missing, are near to nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    at = [F.col(c).cast("double").alias(c) for c in columns]
    placed = F.lit(True)
    for c in columns:
        placed &= F.col(c).isNotNull()
    rows = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("other"), *at).filter(placed)
    s = written(sample.filter(F.col(key).isNotNull()).select(F.col(key).alias("row"), F.col(label).alias("own"), *at), "sample")
    points = rows.groupBy("other", *columns).agg(F.count("*").alias("n"))
    kind = df.schema[label].dataType
    schema = ", ".join([*[f"`{c}` double" for c in columns], f"other {kind.simpleString()}", "d double"])
    asked = s.select(*columns).filter(placed).distinct()
    sums = met(points, asked, ["other", *columns], columns, label_sums(columns, "other", to_arrow_type(kind)), schema).groupBy(*columns, "other").agg(F.sum("d").alias("d"))
    far = s.join(sums, list(columns)).join(F.broadcast(rows.groupBy("other").agg(F.count("*").alias("n"))), "other").select("row", "own", "other", "d", "n")
    # rows of the same key don't count
    same = s.select(F.col("row"), F.col("own"), F.struct(*columns).alias("s")).join(rows.select("_k", "other", F.struct(*columns).alias("o")), F.col("row") == F.col("_k"))
    same = same.select("row", "own", "other", (-_distance(columns, "o", "s")).alias("d"), F.lit(-1).cast("long").alias("n")).filter("d IS NOT NULL")
    none = s.select("row", "own", F.lit(None).cast(kind).alias("other"), F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("n"))
    several = F.broadcast(df.agg((F.min(key) != F.max(key)).alias("several")))
    by = far.unionByName(same).unionByName(none).groupBy("row", "own", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).crossJoin(several).filter("several")
    by = by.withColumn("d", F.when(F.col("n") > 0, F.col("d") / F.col("n")))
    of = by.groupBy("row", "own").agg(F.max(F.when(F.col("other") == F.col("own"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("own"), F.col("d"))).alias("b"))
    out = of.withColumn("s", F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
    return out.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"), F.avg((F.col("s") < 0).cast("int")).alias("negative"))


def scored_segments(df: DataFrame, centroids: DataFrame, key: str, label: str, columns: Sequence[str], unsure: float = 0.1) -> DataFrame:
    """key, segment (the nearest centroid), margin and boundary: margin is how much farther, as a share, the second nearest is; under unsure the row lies on a boundary.

    centroids: label and columns, one row a segment; broadcast, as there are few.
    """
    c = F.broadcast(centroids.select(F.struct(label, *columns).alias("c")))
    far = df.select(F.struct(key, *columns).alias("o")).crossJoin(c).select(F.col(f"o.{key}").alias(key), F.struct(_distance(columns, "o", "c").alias("d"), F.col(f"c.{label}").alias("l")).alias("x"))
    two = far.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("x")), 1, 2).alias("x"))
    margin = F.when(F.size("x") > 1, F.when(F.col("x")[1]["d"] > 0, 1 - F.col("x")[0]["d"] / F.col("x")[1]["d"]).otherwise(0.0)).otherwise(1.0)
    return two.select(key, F.col("x")[0]["l"].alias("segment"), margin.alias("margin")).withColumn("boundary", F.col("margin") < unsure)


def hopkins(df: DataFrame, key: str, columns: Sequence[str], probes: int = 50, seed: int = 7) -> DataFrame:
    """Hopkins statistic: about 0.5 for evenly spread rows, near 1 for clustered ones.

    So many rows, and as many even points in the bounding box, look for the nearest row; both sets are broadcast.
    """
    box = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    unit = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.col("id")), F.lit(1_000_003)) / 1_000_003.0
    even = df.sparkSession.range(probes).crossJoin(box).select(F.lit("even").alias("kind"), F.lit(None).cast(df.schema[key].dataType).alias("of"), *[(F.col(f"lo_{c}") + unit(c) * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(c) for c in columns])
    rows = df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(probes).select(F.lit("row").alias("kind"), F.col(key).alias("of"), *[F.col(c).cast("double").alias(c) for c in columns])
    asked = F.broadcast(even.unionByName(rows).select(F.struct("kind", "of", *columns).alias("q")))
    near = df.select(F.struct(key, *columns).alias("o")).crossJoin(asked).filter(~F.col(f"o.{key}").eqNullSafe(F.col("q.of")))
    least = near.groupBy("q").agg(F.min(_distance(columns, "o", "q")).alias("d"))
    total = least.agg(F.sum(F.when(F.col("q.kind") == "even", F.col("d"))).alias("u"), F.sum(F.when(F.col("q.kind") == "row", F.col("d"))).alias("w"))
    return total.select((F.col("u") / (F.col("u") + F.col("w"))).alias("hopkins"))
