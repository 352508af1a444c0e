"""Upper-tail probabilities for F, t and chi-square statistics.

Spark computes the statistics; these helpers turn the few result rows into
p-values, by continued fractions for the incomplete beta and gamma functions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Modified Lentz evaluation of the incomplete-beta continued fraction."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < _EPS:
            return h
    raise ArithmeticError(f"the incomplete beta function of {a}, {b}, {x} did not converge")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1.0 - s
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < _EPS:
            return front * h
    raise ArithmeticError(f"the incomplete gamma function of {s}, {x} did not converge")


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def _ok(*values: object) -> bool:
    return all(v is not None and not pd.isna(v) for v in values)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of F(d1, d2); an infinite statistic has p = 0."""
    return pd.Series([
        None if not _ok(a, b, c) or b <= 0 or c <= 0 else (0.0 if math.isinf(a) else f_upper(a, b, c))
        for a, b, c in zip(f, d1, d2)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if not _ok(a, b) or b <= 0 else chi2_upper(a, b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        None if not _ok(a, b) or b <= 0 else (0.0 if math.isinf(a) else t_two_sided(a, b)) for a, b in zip(t, df)
    ], dtype="float64")


def corr_t(r: Column, n: Column) -> Column:
    """AN-03: t statistic of a correlation; infinite when |r| >= 1."""
    return F.when(F.abs(r) >= 1, F.lit(float("inf"))).when(n > 2, r * F.sqrt((n - 2) / (1 - r * r)))


def corr_pvalue(r: Column, n: Column) -> Column:
    """AN-03: two-sided p of a Pearson r over n pairs; 0 when |r| >= 1."""
    return F.when(n > 2, t_pvalue(corr_t(r, n), (n - 2).cast("double")))
