"""Tail probabilities of the t and F distributions (vectorised Arrow UDFs).

Spark SQL has no incomplete beta function. These run on result rows (one per
species, pair of columns or coefficient), never on fact rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldtally.functions import ship_by_value

ship_by_value(__name__)

_TINY = 1e-300
_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Modified Lentz evaluation for the incomplete beta function."""

    def away_from_zero(v):
        return np.where(np.abs(v) < _TINY, _TINY, v)

    c = np.ones_like(x)
    d = 1.0 / away_from_zero(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / away_from_zero(1.0 + step * d)
            c = away_from_zero(1.0 + step / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def regularised_beta(a, b, x) -> np.ndarray:
    """I_x(a, b), elementwise; NaN in, NaN out."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    inner = ok & (x > 0) & (x < 1)
    if inner.any():
        ai, bi, xi = a[inner], b[inner], x[inner]
        front = np.exp(
            _log_gamma(ai + bi) - _log_gamma(ai) - _log_gamma(bi) + ai * np.log(xi) + bi * np.log1p(-xi)
        )
        lower = xi < (ai + 1.0) / (ai + bi + 2.0)
        aa, bb, xx = np.where(lower, ai, bi), np.where(lower, bi, ai), np.where(lower, xi, 1.0 - xi)
        part = front * _continued_fraction(aa, bb, xx) / aa
        out[inner] = np.where(lower, part, 1.0 - part)
    return out


@F.pandas_udf(DoubleType())
def _t_tails(t: pd.Series, df: pd.Series) -> pd.Series:
    t_, df_ = t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)
    p = pd.Series(regularised_beta(df_ / 2.0, 0.5, df_ / (df_ + t_ * t_)))
    return p.where(p.notna(), None)


@F.pandas_udf(DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    f_, n, d = (s.to_numpy(float, na_value=np.nan) for s in (f, df1, df2))
    p = pd.Series(regularised_beta(d / 2.0, n / 2.0, d / (d + n * f_)))
    return p.where(p.notna(), None)


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return _t_tails(t.cast("double"), df.cast("double"))


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    """Upper-tail p-value of an F statistic."""
    return _f_tail(f.cast("double"), df1.cast("double"), df2.cast("double"))
