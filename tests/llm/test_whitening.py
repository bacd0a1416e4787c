"""Exact whitening against numpy's eigenvectors, exact fractions and a plain determinant."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>"


def fit_list(vectors):
    return np.array(sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors}), dtype=np.int64)


def sample(n, d, seed=1):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) / 4).astype(np.float32)


@pytest.mark.parametrize(("n", "d"), [(300, 12), (60, 20), (15, 20), (500, 3)])
def test_query_against_numpy(spark, tmp_path, n, d):
    from orefield.llm.queries import op12_whitening

    data = [(i, [float(c) for c in v]) for i, v in enumerate(sample(n, d))]
    data += [(n, data[0][1]), (n + 1, None), (n + 2, [None] + [0.0] * (d - 1)), (n + 3, [math.nan] * d), (n + 4, [math.inf] + [0.0] * (d - 1)), (n + 5, data[1][1])]
    spark.createDataFrame(data, VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    x = fit_list([v for _, v in data[:n]])
    m, s = len(x), x.sum(axis=0)
    v = (lambda c: c.T @ c / m)(x - s / m)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    rank = np.linalg.matrix_rank(v)
    got = op12_whitening(spark, str(tmp_path)).collect()
    assert len(got) == (n + 2) * min(16, rank) and {r.n for r in got} == {m}
    where = {i: np.array([math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e], dtype=np.int64) for i, e in [*data[:n], data[n], data[-1]]}
    for r in got:
        k, exact = r.component - 1, m * where[r.vec_id] - s
        assert r.deviation == int((exact.astype(object) ** 2).sum())
        assert abs(abs(r.whitened) - abs(exact / m @ axes[:, k] / math.sqrt(values[k]))) < 1e-6
        assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9
        assert r.identity_error < 1e-9
    for k in range(min(16, rank)):  # one sign for all rows
        signs = {np.sign(r.whitened * ((m * where[r.vec_id] - s) @ axes[:, k])) for r in got if r.component == k + 1 and abs(r.whitened) > 1e-3}
        assert len(signs) == 1


def test_repeated_variances_have_orthogonal_components(spark):
    from orefield.llm.whitening import by_component, whitened

    # corners of a cube and its longer axis: three equal variances, and one dimension that is always 0
    data = [(i, [float(s) if j == k else 0.0 for j in range(3)] + [0.0, 0.0]) for i, (k, s) in enumerate((k, s) for k in range(3) for s in (1, -1))]
    data += [(6, [0.0] * 3 + [2.0, 0.0]), (7, [0.0] * 3 + [-2.0, 0.0])]
    out = whitened(spark.createDataFrame(data, VECTORS))
    got = out.collect()
    w = np.array([r.whitened for r in got])
    assert w.shape == (8, 4) and np.allclose(w.T @ w / 8, np.eye(4), atol=1e-12)
    assert got[0].identity_error < 1e-12 and np.allclose(got[0].explained, [4 / 7, 1 / 7, 1 / 7, 1 / 7])
    assert by_component(out).count() == 32


def test_polynomial_is_exact(spark):
    from orefield.llm.whitening import characteristic_polynomial, isolated_root, roots_above

    r = random.Random(2)
    for d in (1, 2, 5, 9):
        b = [[r.randint(-(10**6), 10**6) for _ in range(d)] for _ in range(d)]
        a = [[sum(b[k][i] * b[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
        p = characteristic_polynomial(spark, a)
        for t in (0, 1, -7, 10**13 + 1):  # the determinant of t - a in fractions
            m = [[Fraction((t if i == j else 0) - a[i][j]) for j in range(d)] for i in range(d)]
            det = Fraction(1)
            for c in range(d):
                top = next((i for i in range(c, d) if m[i][c]), None)
                if top is None:
                    det = Fraction(0)
                    break
                if top != c:
                    m[c], m[top], det = m[top], m[c], -det
                det *= m[c][c]
                for i in range(c + 1, d):
                    f = m[i][c] / m[c][c]
                    m[i] = [x - f * y for x, y in zip(m[i], m[c])]
            assert sum(c * t**i for i, c in enumerate(p)) == det
    cubic = [-36, 60, -29, 4]  # 4 (t - 3/4) ... has no integer form; take (t - 2)^2 (t - 9) instead
    cubic = [-36, 40, -13, 1]
    assert [roots_above(cubic, x) for x in (-1, 1, 2, 8, 9)] == [3, 3, 1, 1, 0]
    assert isolated_root(cubic, 1, 100) == (9, 1, 1) and isolated_root(cubic, 3, 100) == (2, 2, 2)


def test_wide_values_odd_tables_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from orefield.llm.whitening import by_component, whitened

    df = spark.createDataFrame([("a", [1e15, 0.0], 1), ("b", [-1e15, 3.0], 2), (None, [5e14, 2.0], 3), ("a", [1e300, 1.0], 4), ("c", [1.0], 5), ("d", [], 6)], "k string, embedding array<double>, n long")
    df = df.withColumns({c: F.lit(0) for c in ("y", "whitened", "component", "i", "c", "_judged", "identity_error")})
    got = whitened(df).collect()
    assert [r.k for r in got] == ["a", "b", None, "a"] and all(r.deviation is None for r in got)
    assert got[0].identity_error < 1e-6 and len(got[0].whitened) == 2
    assert by_component(whitened(df.limit(0))).count() == 0
    assert whitened(df.limit(1)).count() == 0  # one vector has no variance
    assert whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], VECTORS)).count() == 0
