"""Tail probabilities for small summary tables, and the inverse normal."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def ks_two_sided(d: float, n1: float, n2: float) -> float:
    """Asymptotic p of the two-sample Kolmogorov-Smirnov statistic."""
    s = d * math.sqrt(n1 * n2 / (n1 + n2))
    if s < 1e-9:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * s) ** 2) for k in range(1, 101))))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kendall_two_sided(tau: float, n: float) -> float:
    """Exact p of Kendall's tau without ties: counts of permutations by number of inversions."""
    n = int(n)
    if n < 2:
        return float("nan")
    counts = [1]
    for k in range(2, n + 1):
        counts = [sum(counts[max(0, j - k + 1) : j + 1]) for j in range(len(counts) + k - 1)]
    total, pairs = sum(counts), n * (n - 1) // 2
    inversions = round((1 - abs(tau)) * pairs / 2)
    return min(1.0, 2 * sum(counts[: inversions + 1]) / total)


def _column(fn):
    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(pd.isna(x) for x in r) else fn(*map(float, r)) for r in rows], dtype="float64")

    return run


def p_of_t(t, df):
    return _column(t_two_sided)(t, df)


def p_of_ks(d, n1, n2):
    return _column(ks_two_sided)(d, n1, n2)


def p_of_normal(z):
    return _column(normal_two_sided)(z)


def p_of_kendall(tau, n):
    return _column(kendall_two_sided)(tau, n)


def inverse_normal(p):
    return _column(NormalDist().inv_cdf)(p)
