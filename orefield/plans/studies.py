"""Studies with pyspark.ml: sweeps, stability, importance. No SQL form."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import models as M
from ..operators.evaluation import r_squared
from ..operators.sampling import fold_of
from ..streaming.monitor import drift_report
from .base import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", array_to_vector("embedding").alias("features"))


@query()
def c20_k_sweep(t: Tables) -> DataFrame:
    return C.sweep(vectors(t), [2, 4, 8])


@query()
def c60_algorithms(t: Tables) -> DataFrame:
    few = t.customer.select("c_custkey", array_to_vector(F.array((F.col("c_acctbal") / 1000), F.col("c_nationkey").cast("double"))).alias("features"))
    return C.shootout(few, 4)


@query()
def c19_stability(t: Tables) -> DataFrame:
    return C.stability(vectors(t), "vec_id", 4, 2)


@query()
def c21_gap(t: Tables) -> DataFrame:
    few = t.customer.select(array_to_vector(F.array((F.col("c_acctbal") / 1000), F.col("c_nationkey").cast("double"))).alias("features"))
    return C.gap_statistic(few, [2, 4], references=2)


@query()
def c26_surrogate(t: Tables) -> DataFrame:
    return C.surrogate(vectors(t), "label")[1]


COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def _fit(columns) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), LinearRegression(labelCol="l_extendedprice", maxIter=10)])


def _r2(scored: DataFrame) -> float:
    return r_squared(scored, "l_extendedprice", "prediction").first().r2


@query()
def c49_cross_validation(t: Tables) -> DataFrame:
    return M.cross_validated(t.lineitem.withColumn("fold", fold_of("l_orderkey", 3)), _fit(COLUMNS), "fold", 3, _r2)


@query()
def c51_importance(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return M.permutation_importance(rows, _fit(COLUMNS).fit(rows), COLUMNS, "l_suppkey", "id", _r2)


@query()
def c52_ablation(t: Tables) -> DataFrame:
    return M.ablation(t.lineitem, _fit, COLUMNS, _r2)


@query()
def t8_drift_report(t: Tables) -> DataFrame:
    return drift_report(t.lineitem.filter("l_orderkey % 2 = 0"), t.lineitem.filter("l_orderkey % 2 = 1"), ["l_quantity", "l_extendedprice"])
