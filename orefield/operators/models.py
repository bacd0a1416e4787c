"""Cross-validation, importance and ablation over pyspark.ml estimators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import table_of
from .stats import permuted

Score = Callable[[DataFrame], float]


def cross_validated(df: DataFrame, estimator: Estimator, fold: str, folds: int, score: Score) -> DataFrame:
    """fold, score of the model that was fitted on the other folds."""
    rows = []
    for k in range(folds):
        model = estimator.fit(df.filter(F.col(fold) != k))
        rows.append({"fold": k, "score": float(score(model.transform(df.filter(F.col(fold) == k))))})
    return table_of(df, rows)


def permutation_importance(df: DataFrame, model: Model, columns: Sequence[str], stratum: str, key: str, score: Score) -> DataFrame:
    """column and how much the score falls when the column's values are shuffled within strata."""
    base = score(model.transform(df))
    return table_of(df, [{"column": c, "drop": float(base - score(model.transform(permuted(df, c, stratum, key))))} for c in columns])


def ablation(df: DataFrame, build: Callable[[Sequence[str]], Estimator], columns: Sequence[str], score: Score) -> DataFrame:
    """left_out (empty: none) and score of a fit without that column."""
    rows = []
    for out in ["", *columns]:
        kept = [c for c in columns if c != out]
        rows.append({"left_out": out, "score": float(score(build(kept).fit(df).transform(df)))})
    return table_of(df, rows)
