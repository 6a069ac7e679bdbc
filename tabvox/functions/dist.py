"""Tails of Student's t, F and the studentised range, vectorised with numpy, as pandas UDFs on small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    out = np.where(x <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(p, df) -> np.ndarray:
    """Upper quantile, p over one half, by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.zeros(p.shape), np.full(p.shape, 1e6)
    for _ in range(200):
        mid = (low + high) / 2
        over = 1 - t_two_sided(mid, df) / 2 > p
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    return (low + high) / 2


def _phi(z):
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def range_upper(q: float, k: int, df: float, inner: int = 240, outer: int = 400) -> float:
    """Upper tail of the studentised range, by the trapezoid rule in both variables."""
    if not (q > 0 and k > 1 and df > 0):
        return 1.0 if q == 0 else float("nan")
    z = np.linspace(-8, 8, inner + 1)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    span = 8 / math.sqrt(df)
    s = np.linspace(max(1e-6, 1 - span), 1 + span, outer + 1)
    log = (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    within = np.array([np.trapezoid(k * density * np.clip(_phi(z) - _phi(z - q * x), 0, 1) ** (k - 1), z) for x in s])
    weight = np.exp(log)
    return float(np.clip(1 - np.trapezoid(within * weight, s) / np.trapezoid(weight, s), 0, 1))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float))).where(t.notna().to_numpy() & df.notna().to_numpy())


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float))).where(f.notna().to_numpy())


@F.pandas_udf(DoubleType())
def t_975(df: pd.Series) -> pd.Series:
    return pd.Series(t_quantile(0.975, df.to_numpy(float))).where(df.notna().to_numpy())


@F.pandas_udf(DoubleType())
def tukey_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([range_upper(a, int(b), c) if a == a and c == c else None for a, b, c in zip(q, k, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def wilcoxon_exact_p(w: pd.Series, ranks: pd.Series) -> pd.Series:
    """Two-sided exact p of the smaller signed-rank sum, from twice the (perhaps tied) ranks of the nonzero differences."""
    def one(w, twice):
        ways = np.zeros(int(sum(twice)) + 1)
        ways[0] = 1
        for r in twice:
            ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
        return min(1.0, 2 * ways[: int(round(2 * w)) + 1].sum() / 2.0 ** len(twice))

    return pd.Series([one(a, [int(x) for x in b]) if b is not None and len(b) else None for a, b in zip(w, ranks, strict=True)], dtype=float)
