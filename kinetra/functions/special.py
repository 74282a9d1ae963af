"""Tail probabilities that Spark lacks, as small helpers for rows of already aggregated tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def f_tail(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_tail(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def range_cdf(q: float, k: int, nodes: int = 200) -> float:
    """Studentised range of k means with infinite degrees of freedom: P(Q <= q), by Gauss-Legendre sums over the least mean.

    k times the integral of phi(z) (Phi(z + q) - Phi(z))^(k - 1): the least of k lies at z, the others within q above it.
    """
    if q <= 0:
        return 0.0
    x, w = np.polynomial.legendre.leggauss(nodes)
    lo, hi = -9.0, 9.0
    z = (hi - lo) / 2 * x + (hi + lo) / 2
    phi = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    above = np.array([0.5 * math.erfc(-(v + q) / math.sqrt(2)) for v in z])
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return float(min(1.0, k * (hi - lo) / 2 * (w * density * (above - phi) ** (k - 1)).sum()))


def range_quantile(p: float, k: int) -> float:
    """q with range_cdf(q, k) = p, by bisection."""
    lo, hi = 0.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if range_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def signed_rank_p(w: float, n: int, squares: float, exact: int = 50) -> float:
    """Two-sided p of a signed-rank sum w <= its mean over n pairs, squares: the sum of their squared ranks.

    Up to `exact` pairs without ties by counting subsets of ranks; else by the normal distribution, whose variance of
    squares / 4 has the correction for ties in it.
    """
    if n <= exact and squares == n * (n + 1) * (2 * n + 1) / 6:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    return normal_tail((w - n * (n + 1) / 4) / math.sqrt(squares / 4))


@F.pandas_udf(DoubleType())
def f_tail_udf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f_tail(v, a, b) for v, a, b in zip(x, d1, d2, strict=True)])


@F.pandas_udf(DoubleType())
def t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or d < 1 else t_quantile(v, d) for v, d in zip(p, df, strict=True)])


@F.pandas_udf(DoubleType())
def t_tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or d < 1 else t_tail(v, d) for v, d in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def signed_rank_udf(w: pd.Series, n: pd.Series, squares: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or k < 3 else signed_rank_p(v, int(k), q) for v, k, q in zip(w, n, squares, strict=True)])


@F.pandas_udf(DoubleType())
def range_quantile_udf(p: pd.Series, k: pd.Series) -> pd.Series:
    found = {(a, b): range_quantile(a, int(b)) if b > 1 else None for a, b in set(zip(p, k, strict=True))}
    return pd.Series([found[x] for x in zip(p, k, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def range_tail_udf(q: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or n < 2 else max(0.0, 1 - range_cdf(v, int(n))) for v, n in zip(q, k, strict=True)], dtype=float)
