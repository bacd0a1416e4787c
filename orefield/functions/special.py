"""Special functions as columns of built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_factorial(n: Column) -> Column:
    """ln n!: exact below 20, Stirling's series with three terms above (error under 1e-12)."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)])
    x = n.cast("double")
    series = x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 20, F.element_at(small, (F.least(n, F.lit(19)) + 1).cast("int"))).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def _tail(start: Column, steps: Column, ratio, n1: Column, m1: Column, n: Column) -> Column:
    """P(start) + P(start + 1) + ... in the order of steps, each term by its ratio to the one before."""
    first = F.exp(ln_choose(n1, start) + ln_choose(n - n1, m1 - start) - ln_choose(n, m1))
    one = F.struct(first.alias("term"), first.alias("total"))
    return F.aggregate(
        steps, one, lambda s, x: F.struct((s["term"] * ratio(x)).alias("term"), (s["total"] + s["term"] * ratio(x)).alias("total")), lambda s: s["total"]
    )


def fisher_right(n11: Column, n1: Column, m1: Column, n: Column) -> Column:
    """P(X >= n11) of the hypergeometric distribution with these margins.

    Above the mean it is the sum of the right tail, else 1 less the left tail, so terms only fall from the first on.
    """
    lo, hi = F.greatest(n1 + m1 - n, F.lit(0)), F.least(n1, m1)
    none = F.array().cast("array<bigint>")
    up = lambda x: (n1 - x) * (m1 - x) / ((x + 1.0) * (n - n1 - m1 + x + 1))  # noqa: E731  from x to x + 1
    down = lambda x: x * (n - n1 - m1 + x) / ((n1 - x + 1.0) * (m1 - x + 1))  # noqa: E731  from x to x - 1
    right = _tail(n11, F.when(n11 < hi, F.sequence(n11, hi - 1)).otherwise(none), up, n1, m1, n)
    left = _tail(n11 - 1, F.when(n11 - 1 > lo, F.sequence(n11 - 1, lo + 1, F.lit(-1).cast("long"))).otherwise(none), down, n1, m1, n)
    return F.when(n11 <= lo, 1.0).when(n11 * n > n1 * m1, F.least(right, F.lit(1.0))).otherwise(F.greatest(1 - left, F.lit(0.0)))
