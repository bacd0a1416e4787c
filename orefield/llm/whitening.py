"""Whitening of embeddings by an exact characteristic polynomial.

An entry c of a vector is the integer floor(64 c). (That the contract adds 1,000,000 to it changes no centred figure, so it
isn't added.) The fit list is each distinct integer vector once. Of its n vectors with sums S the integer scatter
A = n * sum(y y') - S S' = n^2 * covariance is added up exactly; its characteristic polynomial is found modulo primes of 31
bits (Hessenberg form) and put together by Chinese remainders. Its roots are all real, so the sign changes of its
coefficients, shifted to a, count the roots above a exactly (Descartes); bisection isolates and narrows each of the
largest roots, repeated ones too. Components are the null space of A - root, by inverse iteration in 320 bits.

Work that grows with the rows is in Spark tasks, and so is that which grows with the dimensions: a task for some primes, a
task for each component. The driver has the scatter (dimensions squared) and the polynomial only.

Dropped are rows whose vector is null or holds null or non-finite entries, and those whose length isn't the commonest
(of equally common ones the longest). A component whose variance is zero doesn't exist, so equal vectors, one vector or
an empty table give no rows. Entries beyond a long's range count as its ends. A deviation beyond a long is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, ship

COMPONENTS = 16
#: Bits after the point of roots, in units of the scatter's trace, and of vectors in inverse iteration.
ROOT_BITS, VECTOR_BITS = 160, 320
#: Exact sums travel as limbs of 40 bits, so that 2^23 tasks can be added up in longs.
LIMB, LIMBS = 40, 4
LONG = 1 << 63


def integer_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df with y, the integers of the vector; rows without a whole vector of the commonest length are gone."""
    entry = F.col(vector)
    fine = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    whole = df.filter(entry.isNotNull() & fine)
    common = whole.groupBy(F.size(entry).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    return whole.filter(F.size(entry) == size).withColumn("y", F.transform(entry, lambda c: F.floor(c.cast("double") * 64)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def _products(y: np.ndarray) -> np.ndarray:
    """y' y in exact integers."""
    if _largest(y) ** 2 * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _limbs(values: list[int]) -> list[list[int]]:
    """Digits of each value to the base 2^LIMB, all with its sign."""
    mask = (1 << LIMB) - 1
    return [[(abs(v) >> (LIMB * i) & mask) * (-1 if v < 0 else 1) for i in range(LIMBS)] for v in values]


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and n * sum(y y') - S S' of the rows, exactly."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, squares = 0, 0, 0
        for batch in batches:
            if len(batch):
                y = _matrix(batch["y"])
                for part in np.array_split(y, -(-len(y) // 1024)):
                    n, total, squares = n + len(part), total + part.astype(object).sum(axis=0), squares + _products(part)
        if n:
            flat = [n, *total, *squares[np.triu_indices(len(total))]]
            yield pd.DataFrame(_limbs([int(v) for v in flat]), columns=[f"l{i}" for i in range(LIMBS)]).assign(at=range(len(flat)))

    names = [f"l{i}" for i in range(LIMBS)]
    parts = fit.select("y").mapInPandas(sums, ", ".join(f"{c} long" for c in names) + ", at int")
    rows = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).orderBy("at").collect()
    if not rows:
        return 0, [], []
    values = [sum(int(r[c]) << (LIMB * i) for i, c in enumerate(names)) for r in rows]
    n, d = values[0], (math.isqrt(8 * len(values) + 1) - 3) // 2
    total, upper = values[1 : d + 1], iter(values[d + 1 :])
    a = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            a[i][j] = a[j][i] = n * next(upper) - total[i] * total[j]
    return n, total, a


def primes_below(top: int, product: int) -> list[int]:
    """The largest primes below top whose product passes the given one."""

    def prime(p: int) -> bool:  # Miller and Rabin; these bases are enough below 3.2e9
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            x = pow(base, odd, p)
            if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, have, p = [], 1, top - 1 - top % 2
    while have <= product:
        if prime(p):
            found.append(p)
            have *= p
        p -= 2
    return found


def polynomial_modulo(a: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t - a) modulo a prime below 2^31, from the constant one upwards."""
    h = np.array([[v % p for v in row] for row in a], dtype=np.int64)
    d = len(h)
    for m in range(1, d - 1):  # similar matrix without entries below the first lower diagonal
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), dtype=np.int64)  # row k: polynomial of the leading k by k part
    leading[0, 0] = 1
    for k in range(1, d + 1):
        row = np.concatenate(([0], leading[k - 1, :-1])) - h[k - 1, k - 1] * leading[k - 1] % p
        weights, below = np.zeros(k - 1, dtype=np.int64), 1
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k - 1]) * below % p
        leading[k] = (row - (weights[:, None] * leading[: k - 1] % p).sum(axis=0)) % p
    return leading[d].tolist()


def characteristic_polynomial(spark, a: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t - a) of a positive semidefinite matrix, from the constant one upwards."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))  # roots of a given sum: the coefficients are largest if all are equal
    primes = primes_below(1 << 31, bound)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                yield pd.DataFrame({"id": [i], "c": [polynomial_modulo(a, primes[i])]})

    tasks = min(len(primes), 2 * spark.sparkContext.defaultParallelism)
    found = {r.id: r.c for r in spark.range(0, len(primes), 1, tasks).mapInPandas(solve, "id long, c array<long>").collect()}
    modulus = math.prod(primes)
    lifts = [modulus // p * pow(modulus // p, -1, p) for p in primes]
    out = []
    for k in range(d + 1):
        value = sum(found[i][k] * lift for i, lift in enumerate(lifts)) % modulus
        out.append(-(modulus - value) if (d - k) % 2 and value else value)  # signs alternate, as no root is negative
    return out


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only are over a, repeated ones as often: sign changes of p(t + a)."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolated_root(coefficients: list[int], k: int, top: int) -> tuple[int, int, int]:
    """root, first, count: the k-th largest root lies in (root - 1, root]; roots first to first + count - 1 (from 1) share that interval."""

    def at(t: int) -> int:
        value = 0
        for c in reversed(coefficients):
            value = value * t + c
        return value

    low, high, above_low, above_high = -1, top, len(coefficients) - 1, 0
    while high - low > 1 and above_low - above_high > 1:
        middle = (low + high) // 2
        above = roots_above(coefficients, middle)
        if above >= k:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    if above_low - above_high == 1:
        sign = at(high) > 0 if at(high) else None
        if sign is None:  # the root is an integer: it is high itself
            return high, k, 1
        while high - low > 1:
            middle = (low + high) // 2
            value = at(middle)
            if value == 0 or (value > 0) == sign:
                high = middle
                if value == 0:
                    break
            else:
                low = middle
    return high, above_high + 1, above_low - above_high


def null_space(a: list[list[int]], root: int, scale: int, count: int) -> list[list[int]]:
    """count orthogonal vectors, times 2^VECTOR_BITS, that a - root / 2^scale takes to almost nothing."""
    d, unit = len(a), VECTOR_BITS
    size = max(1, max(abs(v) for row in a for v in row).bit_length())
    shift = unit - size
    # a hair beside the root, as the matrix at a rational root is singular
    m = np.array([[((v << scale) - ((root << 1) + 1 if i == j else 0) // 2 << shift) >> scale for j, v in enumerate(row)] for i, row in enumerate(a)], dtype=object)
    for i in range(d):
        m[i, i] += 1 << (shift - scale) if shift > scale else 1
    vectors = np.array([[((2654435761 * (i + 1) + 40503 * (r + 1) * (i + 7)) % (1 << 32) + 1) << (unit - 32) for r in range(count)] for i in range(d)], dtype=object)
    for _ in range(3):
        left, right = m.copy(), vectors.copy()
        for c in range(d):
            pivot = max(range(c, d), key=lambda r: abs(left[r, c]))
            if pivot != c:
                left[[c, pivot]], right[[c, pivot]] = left[[pivot, c]], right[[pivot, c]]
            top = left[c, c] or 1
            for r in range(c + 1, d):
                if left[r, c]:
                    f = (left[r, c] << unit) // top
                    left[r, c:] -= f * left[c, c:] >> unit
                    right[r] -= f * right[c] >> unit
        for c in range(d - 1, -1, -1):
            rest = right[c] - (left[c, c + 1 :] @ right[c + 1 :] >> unit) if c + 1 < d else right[c]
            right[c] = np.array([(int(v) << unit) // (left[c, c] or 1) for v in rest], dtype=object)
        for r in range(count):  # orthogonal and of length 1
            v = right[:, r]
            for _again in range(2):
                v = _unit(v, unit)
                for q in range(r):
                    v = v - (int(vectors[:, q] @ v) >> unit) * vectors[:, q] // (1 << unit)
            vectors[:, r] = _unit(v, unit)
    return [[int(x) for x in vectors[:, r]] for r in range(count)]


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int(v @ v)) or 1
    return np.array([(int(x) << bits) // length for x in v], dtype=object)


def components(spark, a: list[list[int]], most: int = COMPONENTS) -> list[tuple[int, int, list[float]]]:
    """(root, scale, unit vector) of the largest positive roots, falling; the eigenvalue of a is root / 2^scale."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    if trace == 0:
        return []
    polynomial = characteristic_polynomial(spark, a)
    zeros = next(i for i, c in enumerate(polynomial) if c)
    scale = max(8, ROOT_BITS - trace.bit_length())
    scaled = [c << (scale * (d - zeros - i)) for i, c in enumerate(polynomial[zeros:])]  # roots times 2^scale, without those that are 0

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                root, first, count = isolated_root(scaled, int(k), trace << scale)
                v = null_space(a, root, scale, count)[int(k) - first]
                yield pd.DataFrame({"id": [k], "root": [str(root)], "v": [[x / (1 << VECTOR_BITS) for x in v]]})

    wanted = min(most, d - zeros)
    rows = spark.range(1, wanted + 1, 1, wanted).mapInPandas(solve, "id long, root string, v array<double>").orderBy("id").collect()
    return [(int(r.root), scale, list(r.v)) for r in rows]


def _whitener(n: int, total: list[int], found: list[tuple[int, int, list[float]]]):
    """Function of y: exact n y - S, and (y - S / n) on the components, over the roots of their variances."""
    s = np.array(total, dtype=object)
    axes = np.array([v for *_, v in found]).T / np.array([n * math.sqrt(root / (n * n << scale)) for root, scale, _ in found])
    small = max(abs(v) for v in total)

    def of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = n * _largest(y) + small < 1 << 62
        exact = n * y - s.astype(np.int64) if whole else n * y.astype(object) - s
        return exact, exact.astype(np.float64) @ axes

    return of


def _squares(exact: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; None beyond a long."""
    if _largest(exact) ** 2 * exact.shape[1] < LONG:
        return (exact * exact).sum(axis=1).tolist()
    wide = exact.astype(object)
    return [int(v) if v < LONG else None for v in (wide * wide).sum(axis=1)]


def whitened(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """df's remaining rows with n, deviation, whitened (a double for each component), explained (its share of the trace) and identity_error.

    Columns of df that have such a name or the name y give way.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "whitening")
    kept = df.drop(*[c for c in df.columns if c.lower() in ("y", "n", "deviation", "whitened", "explained", "identity_error") and c != vector])
    rows = integer_vectors(kept, vector)
    fit = scratch.written(rows.select("y").distinct(), "fit")
    n, total, a = scatter(fit)
    found = components(spark, a, most) if n else []
    if not found:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double"))]
        return rows.drop("y").select("*", *empty).filter(F.lit(False))
    trace = sum(a[i][i] for i in range(len(a)))
    explained = [root / (trace << scale) for root, scale, _ in found]
    apply, k = _whitener(n, total, found), len(found)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                w = apply(_matrix(batch["y"]))[1]
                sums, squares = sums + w.sum(axis=0), squares + w.T @ w
        flat = [*sums, *squares.ravel()]
        yield pd.DataFrame({"at": range(len(flat)), "v": flat})

    got = [r.v for r in fit.mapInPandas(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()]
    mean = np.array(got[:k]) / n
    error = float(np.abs(np.array(got[k:]).reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    @F.pandas_udf("deviation long, whitened array<double>")
    def judged(y: pd.Series) -> pd.DataFrame:
        exact, w = apply(_matrix(y))
        return pd.DataFrame({"deviation": pd.array(_squares(exact), dtype="Int64"), "whitened": list(w)})

    at = fresh(rows, "judged")
    out = rows.withColumn(at, judged("y")).drop("y")
    shares = F.array(*[F.lit(x) for x in explained])
    return out.withColumns({"n": F.lit(n).cast("long"), "deviation": F.col(f"{at}.deviation"), "whitened": F.col(f"{at}.whitened"), "explained": shares, "identity_error": F.lit(error)}).drop(at)


def by_component(out: DataFrame) -> DataFrame:
    """A row for each row of whitened and each component, numbered from 1."""
    i, c = fresh(out, "i_"), fresh(out, "c_")
    each = out.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias(i, c))
    return each.withColumns({"component": F.col(i) + 1, "whitened": F.col(f"{c}.whitened"), "explained": F.col(f"{c}.explained")}).drop(i, c)
