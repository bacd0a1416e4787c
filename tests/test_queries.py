"""Every registered query outside llm against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from orefield import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.8g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    out = QUERIES[name](spark, SF_DIR)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(out.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_the_same_again(spark, name):
    def rows():
        return sorted((tuple(float(f"{v:.5g}") if isinstance(v, float) else str(v) for v in r) for r in QUERIES[name](spark, SF_DIR).collect()), key=str)

    assert rows() == rows()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
