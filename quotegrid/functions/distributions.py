"""Tail probabilities as Spark columns, and a vectorised Student t quantile.

Everything but the t quantile stays JVM-side.
"""

from __future__ import annotations

from math import gamma, lgamma
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quotegrid.functions.exprs import col

SQRT_PI = 1.7724538509055159


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_one_quantile(p: float) -> float:
    """Quantile of chi-squared with one degree of freedom."""
    return normal_quantile((1 + p) / 2) ** 2


def erf(x: str | Column, terms: int = 120) -> Column:
    """Error function for x >= 0 by its all-positive series; 1 from 6 on."""
    x = col(x)
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(x.alias("t"), x.alias("s")),
        lambda a, n: F.struct(
            (a["t"] * x * x * 2 / (n * 2 + 1)).alias("t"), (a["s"] + a["t"] * x * x * 2 / (n * 2 + 1)).alias("s")
        ),
    )
    return F.when(x >= 6, F.lit(1.0)).otherwise(state["s"] * F.exp(-x * x) * (2 / SQRT_PI))


def chi2_sf(x: str | Column, df: int) -> Column:
    """Upper tail of chi-squared for an integer number of degrees of freedom (closed forms)."""
    half = col(x) / 2
    if df % 2 == 0:
        total = F.lit(0.0)
        for i in range(df // 2):
            total = total + F.pow(half, F.lit(float(i))) / gamma(i + 1)
        return F.exp(-half) * total
    total = F.lit(0.0)
    for j in range(1, (df - 1) // 2 + 1):
        total = total + F.pow(half, F.lit(j - 0.5)) / gamma(j + 0.5)
    return 1 - erf(F.sqrt(half)) + F.exp(-half) * total


def kolmogorov_sf(lam: str | Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov tail."""
    x = col(lam)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda a, j: a + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, element-wise."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    log_front = np.vectorize(lgamma)(a + b) - np.vectorize(lgamma)(a) - np.vectorize(lgamma)(b)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_front + a * np.log(inner) + b * np.log1p(-inner))
    direct = x < (a + 1) / (a + b + 2)
    value = np.where(
        direct, front * _beta_fraction(a, b, inner) / a, 1 - front * _beta_fraction(b, a, 1 - inner) / b
    )
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / (df + t * t), df / 2, np.full_like(df, 0.5))


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile (p > 0.5) by bisection on distinct degrees of freedom."""
    df = np.asarray(df, float)
    uniq, back = np.unique(df, return_inverse=True)
    lo, hi = np.zeros_like(uniq), np.full_like(uniq, 1000.0)
    while (below := 1 - t_two_sided_p(hi, uniq) / 2 < p).any():
        hi = np.where(below, hi * 1000, hi)
        if not np.isfinite(hi).all():
            raise ValueError(f"no finite t quantile at {p}")
    for _ in range(200):
        mid = (lo + hi) / 2
        inside = 1 - t_two_sided_p(mid, uniq) / 2 < p
        lo, hi = np.where(inside, mid, lo), np.where(inside, hi, mid)
    return ((lo + hi) / 2)[back]


def t_critical(df: str | Column, confidence: float = 0.95) -> Column:
    p = 1 - (1 - confidence) / 2

    @F.pandas_udf("double")
    def critical(v: pd.Series) -> pd.Series:
        return pd.Series(t_quantile(p, v.to_numpy(dtype=float)))

    return critical(col(df).cast("double"))


def t_p_value(t: str | Column, df: str | Column) -> Column:
    @F.pandas_udf("double")
    def p_value(tv: pd.Series, dv: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided_p(tv.to_numpy(dtype=float), dv.to_numpy(dtype=float)))

    return p_value(col(t).cast("double"), col(df).cast("double"))


def f_p_value(f: str | Column, d1: str | Column, d2: str | Column) -> Column:
    @F.pandas_udf("double")
    def p_value(fv: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f_sf(fv.to_numpy(dtype=float), a.to_numpy(dtype=float), b.to_numpy(dtype=float)))

    return p_value(col(f).cast("double"), col(d1).cast("double"), col(d2).cast("double"))
