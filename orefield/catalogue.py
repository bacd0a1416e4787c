"""Every query of the library outside llm: name, function and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import MODULES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star join: revenue of the best customers in a half-open date range."""
    return queries()["j1_star_join_top_customers"](spark, sf_dir)
