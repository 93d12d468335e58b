"""Tail probabilities of the binomial and the chi-square distribution, exact at any size, for tables of few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, out = 1.0, 0.0, 1.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + step * d) or tiny)
        c = (1 + step / c) or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (out - 1)


def _log_mass(k: int, n: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def _at_most(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else beta_share(n - k, k + 1, 1 - p)


def binomial_p(k: int, n: int, p: float) -> float:
    """Two-sided exact binomial test: all outcomes no likelier than the observed one, as two tails of one sum each."""
    if not 0 < p < 1:
        return 1.0 if (p == 0 and k == 0) or (p == 1 and k == n) else 0.0
    most, limit = math.floor((n + 1) * p), _log_mass(k, n, p) + 1e-7
    if _log_mass(most, n, p) <= limit:
        return 1.0
    # the other tail begins where the mass has fallen to the observed one's; it only falls away from the mode
    low, high = (most, n + 1) if k < most else (-1, most)
    while high - low > 1:
        middle = (low + high) // 2
        if (_log_mass(middle, n, p) <= limit) == (k < most):
            high = middle
        else:
            low = middle
    left, right = (k, high) if k < most else (low, k)
    return min(1.0, _at_most(left, n, p) + 1 - _at_most(right - 1, n, p) if right <= n else _at_most(left, n, p))


def chi_square_p(x: float, dof: int) -> float:
    """The chance of a chi-square of ``x`` or more: the finite sum for whole degrees of freedom."""
    half = x / 2
    term, total = (math.exp(-half), 0.0) if dof % 2 == 0 else (math.sqrt(half / math.pi) * 2 * math.exp(-half), math.erfc(math.sqrt(half)))
    a = 1.0 if dof % 2 == 0 else 1.5
    while a <= dof / 2:
        total += term
        term *= half / a
        a += 1
    return total


@F.pandas_udf(T.DoubleType())
def _chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if v != v or d < 1 else chi_square_p(v, int(d)) for v, d in zip(x, dof, strict=True)], dtype="float64")


def chi_square_tail(x: Column, dof: Column) -> Column:
    """``chi_square_p`` of columns; null without a degree of freedom."""
    return _chi_square_p(x, dof)
