"""Finishing functions on report rows: p-values and power. One Arrow batch per report."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for numer in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                      -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numer * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numer / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square for whole degrees of freedom, as a finite sum."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(df // 2):
        total += term
        term *= half / (i + 1.5)
    return total


def _lift(fn, *columns: pd.Series) -> pd.Series:
    def safe(*args):
        if any(a is None or a != a for a in args):
            return None
        return fn(*args)
    return pd.Series([safe(*row) for row in zip(*columns)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    return _lift(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), z)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return _lift(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), z)


@F.pandas_udf(T.DoubleType())
def two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _lift(lambda v, n: beta_cdf(n / 2.0, 0.5, n / (n + v * v)) if n > 0 else None, t, df)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _lift(lambda v, n: chi2_tail(v, int(n)), x, df)


@F.pandas_udf(T.DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact binomial test of the discordant counts at one half."""
    def tail(x, y):
        n, k = int(x + y), int(min(x, y))
        if n == 0:
            return 1.0
        # P(X <= k) for Binomial(n, 1/2) through the beta function
        low = beta_cdf(n - k, k + 1, 0.5) if k < n else 1.0
        return min(1.0, 2.0 * low)
    return _lift(tail, b, c)
