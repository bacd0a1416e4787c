"""Features, evaluation, drift and clusters; models by pyspark.ml."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins
from .base import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql

_PRED = "p AS (SELECT l_orderkey AS k, (l_returnflag = 'R')::INTEGER AS y, round((l_quantity * 7 + l_linenumber * 13) % 101 / 101, 4) AS score, l_returnflag AS g FROM lineitem)"


def predictions(t: Tables) -> DataFrame:
    """A label and a made-up score for every line."""
    return t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round((F.col("l_quantity") * 7 + F.col("l_linenumber") * 13) % 101 / 101, 4).alias("score"), F.col("l_linestatus").alias("g"))


def rounded(df: DataFrame, digits: int = 8, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" and c not in but else F.col(c) for c, k in df.dtypes])


@query("""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem) SELECT round(sqrt(avg((ln(1 + greatest(p, 0)) - ln(1 + y)) ** 2)), 8) AS rmsle, round(avg(abs(p - y)), 4) AS mae, round(quantile_cont(abs(p - y), 0.5), 4) AS medae, round(sqrt(avg((p - y) ** 2)), 4) AS rmse,
    round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 8) AS r2, round(avg((abs(p - y) <= 5000)::INT), 8) AS within FROM p""")
def c42_regression_scores(t: Tables) -> DataFrame:
    out = E.regression_scores(t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")), within=5000.0)
    return out.select(*[F.round(c, 4 if c in ("mae", "medae", "rmse") else 8).alias(c) for c in out.columns])


_CONF = "count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND y = 0) AS tn, count(*) AS n, round(avg(-CASE WHEN y = 1 THEN ln(greatest(score, 1e-15)) ELSE ln(1 - least(score, 1 - 1e-15)) END), 8) AS log_loss, round(avg((score - y) ** 2), 8) AS brier"


@query(f"WITH {_PRED}, c AS (SELECT {_CONF} FROM p) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round((tp + tn) / n, 8) AS accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 8) AS mcc, log_loss, brier FROM c")
def c43_class_scores(t: Tables) -> DataFrame:
    return rounded(predictions(t).agg(*E.class_scores(F.col("y"), F.col("score"))))


_CURVE = f"{_PRED}, b AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM p GROUP BY 1), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM b WINDOW w AS (ORDER BY score DESC)), s AS (SELECT sum(pos) AS p, sum(neg) AS n FROM b)"


@query(f"WITH {_CURVE} SELECT round(sum((tp - pos / 2) * neg) / any_value(s.p * s.n), 8) AS roc_auc, round(sum(pos * tp / (tp + fp)) / any_value(s.p), 8) AS pr_auc FROM c, s")
def c44_auc(t: Tables) -> DataFrame:
    return rounded(E.auc(predictions(t)))


@query(f"WITH {_CURVE}, f AS (SELECT score, round(2 * tp / (tp + fp + s.p), 12) AS f FROM c, s) SELECT arg_max(score, (f, score)) AS threshold, round(max(f), 8) AS f1 FROM f")
def c45_threshold(t: Tables) -> DataFrame:
    return rounded(E.best_threshold(predictions(t)))


@query(f"WITH {_PRED} SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(score), 8) AS mean_score, round(avg(y), 8) AS rate FROM p GROUP BY 1")
def c46_calibration(t: Tables) -> DataFrame:
    return rounded(E.calibration(predictions(t), 10))


@query(f"WITH {_PRED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS m, avg(y) AS r FROM p GROUP BY 1) SELECT round(sum(n * abs(m - r)) / sum(n), 8) AS ece FROM b")
def c46_calibration_error(t: Tables) -> DataFrame:
    return rounded(E.calibration_error(E.calibration(predictions(t), 10)))


@query(f"WITH {_PRED.replace('l_returnflag AS g', 'l_linestatus AS g')}, c AS (SELECT g, {_CONF} FROM p GROUP BY 1) SELECT g, n, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall FROM c WHERE n >= 15")
def c47_slices(t: Tables) -> DataFrame:
    out = predictions(t).groupBy("g").agg(F.count("*").alias("n"), *E.class_scores(F.col("y"), F.col("score"))).filter("n >= 15")
    return rounded(out.select("g", "n", "precision", "recall"))


_PSI = """cut AS (SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey % 2 AS h, len(list_filter(e, lambda x: x < {c})) AS bin, count(*) AS n FROM lineitem, cut GROUP BY 1, 2),
    s AS (SELECT bin, greatest(coalesce(sum(n) FILTER (WHERE h = 0) / (SELECT sum(n) FROM b WHERE h = 0), 0), 1e-4) AS e, greatest(coalesce(sum(n) FILTER (WHERE h = 1) / (SELECT sum(n) FROM b WHERE h = 1), 0), 1e-4) AS a FROM b GROUP BY 1) SELECT '{c}' AS "column", round(sum((a - e) * ln(a / e)), 8) AS psi FROM s"""


@query(" UNION ALL ".join("SELECT * FROM (WITH " + _PSI.format(c=c) + ")" for c in ("l_quantity", "l_extendedprice")))
def c29_psi(t: Tables) -> DataFrame:
    return rounded(E.population_stability(t.lineitem.filter("l_orderkey % 2 = 0"), t.lineitem.filter("l_orderkey % 2 = 1"), ["l_quantity", "l_extendedprice"]))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(((SELECT avg({c}) FROM lineitem WHERE l_orderkey % 2 = 1) - avg({c})) / stddev_samp({c}), 8) AS z FROM lineitem WHERE l_orderkey % 2 = 0" for c in ("l_quantity", "l_discount")))
def c32_mean_drift(t: Tables) -> DataFrame:
    return rounded(E.mean_drift(t.lineitem.filter("l_orderkey % 2 = 0"), t.lineitem.filter("l_orderkey % 2 = 1"), ["l_quantity", "l_discount"]))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS c, (o_orderstatus = 'F')::INTEGER AS y, o_orderkey % 5 AS f FROM orders), s AS (SELECT c, f, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2), t AS (SELECT c, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1), p AS (SELECT f, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1)
    SELECT o_orderkey, round((t.s - s.s + 10 * ((SELECT sum(s) FROM p) - p.s) / ((SELECT sum(n) FROM p) - p.n)) / (t.n - s.n + 10), 8) AS encoded FROM o JOIN s ON o.c = s.c AND o.f = s.f JOIN t ON t.c = o.c JOIN p ON p.f = o.f""")
def c34_target_encoding(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % 5).alias("fold"))
    return rounded(E.target_encoding(df, "o_orderpriority", "y", "fold").select("o_orderkey", "encoded"))


@query("""WITH d AS (SELECT o_orderpriority AS a, CASE WHEN o_totalprice > 250000 THEN o_orderpriority ELSE o_orderstatus END AS b FROM orders), c AS (SELECT a, b, count(*) AS n FROM d GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS c FROM c GROUP BY 1), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS same FROM c),
    m AS (SELECT (SELECT sum(r * (r - 1) / 2) FROM r) AS sr, (SELECT sum(c * (c - 1) / 2) FROM k) AS sc, same, t FROM t) SELECT round((same - sr * sc / (t * (t - 1) / 2)) / ((sr + sc) / 2 - sr * sc / (t * (t - 1) / 2)), 8) AS ari,
    round(2 * (SELECT sum(n / t * ln(n * t / (r * k.c))) FROM c JOIN r USING (a) JOIN k USING (b)) / ((SELECT -sum(r / t * ln(r / t)) FROM r) + (SELECT -sum(c / t * ln(c / t)) FROM k)), 8) AS nmi FROM m""")
def c18_agreement(t: Tables) -> DataFrame:
    df = t.orders.select(F.col("o_orderpriority").alias("a"), F.when(F.col("o_totalprice") > 250_000, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("b"))
    return rounded(E.agreement(df, "a", "b"))


@query("""WITH c AS (SELECT c_mktsegment AS g, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer), m AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM c GROUP BY 1), w AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM c), s AS (SELECT g, sum((x - mx) ** 2 + (y - my) ** 2) AS w, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s FROM c JOIN m USING (g) GROUP BY 1),
    d AS (SELECT a.g, max((sa.s + sb.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) AS d FROM m a JOIN m b ON a.g <> b.g JOIN s sa ON sa.g = a.g JOIN s sb ON sb.g = b.g GROUP BY 1)
    SELECT round((SELECT sum(m.n * ((mx - gx) ** 2 + (my - gy) ** 2)) FROM m, w) / (count(*) - 1) / (sum(w) / ((SELECT n FROM w) - count(*))), 8) AS calinski_harabasz, round((SELECT avg(d) FROM d), 6) AS davies_bouldin FROM s""")
def c15_cluster_indices(t: Tables) -> DataFrame:
    out = E.cluster_indices(t.customer.select("c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("double").alias("y")), ["c_acctbal", "y"], "c_mktsegment")
    return out.select(F.round("calinski_harabasz", 8).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 8) AS z FROM customer")
def c7_standardised(t: Tables) -> DataFrame:
    return rounded(E.standardised(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumnRenamed("c_acctbal", "z"))


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars::DOUBLE END AS x FROM documents) SELECT doc_id, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM d)) AS x, (x IS NULL)::INTEGER AS x_was_missing FROM d")
def c3_imputed(t: Tables) -> DataFrame:
    return E.imputed(t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars").cast("double")).alias("x")), ["x"])


@query("WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events) SELECT event_id, round(least(greatest(value, lo), hi), 8) AS value FROM events, q")
def c5_winsorised(t: Tables) -> DataFrame:
    return rounded(E.winsorised(t.events.select("event_id", "value"), ["value"], 0.01, 0.99))


@query("""WITH l AS (SELECT c_mktsegment, 'c_acctbal' AS "column", c_acctbal AS v FROM customer UNION ALL SELECT c_mktsegment, 'c_nationkey', c_nationkey FROM customer), w AS (SELECT "column", avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1), g AS (SELECT c_mktsegment, "column", avg(v) AS mean FROM l GROUP BY 1, 2)
    SELECT c_mktsegment, "column", round(mean, 6) AS mean, round((mean - m) / s, 8) AS z, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs((mean - m) / s) DESC, "column")::INTEGER AS place FROM g JOIN w USING ("column")""")
def c24_profile(t: Tables) -> DataFrame:
    out = E.segment_profile(t.customer, "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return out.withColumns({"mean": F.round("mean", 6), "z": F.round("z", 8)})


@query("""WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: avg_of[i]) AS v FROM (SELECT label, list(a ORDER BY i) AS avg_of FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)), d AS (SELECT vec_id, c.label, list_distance(embedding::DOUBLE[], v) AS d FROM embeddings, c)
    SELECT vec_id, arg_min(label, (d, label)) AS label, round(min(d), 6) AS distance FROM d GROUP BY 1""")
def c14_nearest_centroid(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    long = rows.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    return joins.nearest_centroid(rows, centre, key="vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("SELECT doc_id, quality, band FROM (SELECT doc_id, quality, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END AS band FROM documents JOIN labels USING (doc_id)) WHERE (band > 0)::INT <> quality")
def c54_band_disagreements(t: Tables) -> DataFrame:
    band = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2)
    return t.documents.join(t.labels, "doc_id").select("doc_id", "quality", band.alias("band")).filter((F.col("band") > 0).cast("int") != F.col("quality"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS a, rank() OVER (ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderdate) - 1) / 2 AS b FROM orders) SELECT round(corr(a, b), 8) AS rho FROM r")
def g17_rank_correlation(t: Tables) -> DataFrame:
    return rounded(E.rank_correlation(t.orders, "o_totalprice", "o_orderdate"))


# models


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", array_to_vector("embedding").alias("features"))


def lines(t: Tables) -> DataFrame:
    part = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return VectorAssembler(inputCols=["l_quantity", "p_retailprice", "l_tax"], outputCol="features").transform(part).select("l_orderkey", "l_linenumber", "features", F.log1p("l_extendedprice").alias("label"))


@query()
def c13_kmeans(t: Tables) -> DataFrame:
    model = KMeans(k=8, seed=7, maxIter=10).fit(vectors(t))
    return model.transform(vectors(t)).groupBy("prediction").agg(F.count("*").alias("n"))


@query()
def c11_pca(t: Tables) -> DataFrame:
    model = PCA(k=4, inputCol="features", outputCol="p").fit(vectors(t))
    return model.transform(vectors(t)).select("vec_id", vector_to_array("p").alias("p"))


@query()
def c38_ridge(t: Tables) -> DataFrame:
    train = lines(t)
    model = LinearRegression(regParam=0.1, maxIter=20).fit(train)
    return E.regression_scores(model.transform(train).select(F.expm1("label").alias("y"), F.expm1("prediction").alias("p")))


@query()
def c38_logistic(t: Tables) -> DataFrame:
    df = vectors(t).withColumn("label", (F.col("label") == 0).cast("double"))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(df)
    scored = model.transform(df).select(F.col("label").alias("y"), vector_to_array("probability")[1].alias("score"))
    return E.auc(scored)


@query()
def c39_boosted_trees(t: Tables) -> DataFrame:
    train = lines(t)
    model = GBTRegressor(maxIter=5, maxDepth=3, seed=7).fit(train)
    return E.regression_scores(model.transform(train).select(F.expm1("label").alias("y"), F.expm1("prediction").alias("p")))
