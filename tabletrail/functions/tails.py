"""Tail probabilities and polygamma functions, vectorised with numpy.

They run on rows that are already aggregated (one per test or feature), never on
raw measurements.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_TINY = 1e-300


def _each(function, values):
    """A scalar function of :mod:`math` over an array."""
    return np.fromiter((function(v) for v in values), dtype=float, count=len(values))


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz).

    A value stays as it is once its own steps are over: later ones only add rounding, which
    with many degrees of freedom keeps a batch from ever being over as a whole.
    """
    c, over = np.ones_like(x), np.zeros(x.shape, bool)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            change = d * c
            h = np.where(over, h, h * change)
        over |= np.abs(change - 1.0) < 1e-15
        if over.all():
            return h
    raise ArithmeticError("the continued fraction of the beta function did not converge")


def _log_gamma_step(a):
    """log gamma(a) - log gamma(a + 1/2); by its asymptotic series where the difference would cancel."""
    large = a > 1e3
    out = -(0.5 * np.log(a) - 1 / (8 * a) + 1 / (192 * a**3))
    small = a[~large]
    out[~large] = _each(math.lgamma, small) - _each(math.lgamma, small + 0.5)
    return out


def t_two_sided(t, df):
    """P(|T| >= |t|) for Student's t. Exact far into the tail; df may be infinite."""
    t = np.abs(np.asarray(t, dtype=float))
    df = np.asarray(df, dtype=float)
    t, df = np.broadcast_arrays(t, df)
    p = np.full(t.shape, np.nan)
    p[(t == 0) & (df > 0)] = 1.0
    p[np.isinf(t) & (df > 0)] = 0.0

    normal = np.isinf(df) & np.isfinite(t)
    p[normal] = _each(math.erfc, t[normal] / math.sqrt(2.0))

    ok = np.isfinite(t) & np.isfinite(df) & (df > 0) & (t > 0)
    if ok.any():
        tt, nu = t[ok], df[ok]
        a, b = nu / 2.0, 0.5
        square = tt * tt
        x, rest = nu / (nu + square), square / (nu + square)
        log_beta = _log_gamma_step(a) + math.lgamma(b)
        # log1p keeps both logarithms accurate when x is next to 0 or 1.
        log_front = -a * np.log1p(square / nu) - b * np.log1p(nu / square) - log_beta
        front = np.exp(log_front)
        near = x < (a + 1.0) / (a + b + 2.0)
        value = np.empty_like(x)
        value[near] = front[near] * _beta_fraction(a[near], b, x[near]) / a[near]
        far = ~near
        value[far] = 1.0 - front[far] * _beta_fraction(np.full(far.sum(), b), a[far], rest[far]) / b
        p[ok] = value
    return p


def f_upper(f, df1, df2):
    """P(F >= f) of the F distribution with ``df1`` and ``df2`` degrees of freedom."""
    f, df1, df2 = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (f, df1, df2)])
    p = np.full(f.shape, np.nan)
    p[(f == 0) & (df1 > 0) & (df2 > 0)] = 1.0
    ok = np.isfinite(f) & (f > 0) & (df1 > 0) & (df2 > 0)
    if ok.any():
        ff, d1, d2 = f[ok], df1[ok], df2[ok]
        a, b = d2 / 2, d1 / 2
        x, rest = d2 / (d2 + d1 * ff), d1 * ff / (d2 + d1 * ff)
        log_beta = _each(math.lgamma, a) + _each(math.lgamma, b) - _each(math.lgamma, a + b)
        front = np.exp(-a * np.log1p(d1 * ff / d2) - b * np.log1p(d2 / (d1 * ff)) - log_beta)
        near = x < (a + 1.0) / (a + b + 2.0)
        value = np.empty_like(x)
        value[near] = front[near] * _beta_fraction(a[near], b[near], x[near]) / a[near]
        far = ~near
        value[far] = 1.0 - front[far] * _beta_fraction(b[far], a[far], rest[far]) / b[far]
        p[ok] = value
    return p


def digamma(x):
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    while np.any(x < 10):
        low = x < 10
        shift[low] -= 1.0 / x[low]
        x[low] += 1.0
    inv2 = 1.0 / (x * x)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return shift + np.log(x) - 0.5 / x - series


def trigamma(x):
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    while np.any(x < 10):
        low = x < 10
        shift[low] += 1.0 / (x[low] * x[low])
        x[low] += 1.0
    inv = 1.0 / x
    inv2 = inv * inv
    series = inv * (1 + inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 * (1 / 30 - inv2 * 5 / 66)))))
    return shift + series + 0.5 * inv2


def trigamma_inverse(value: float) -> float:
    """y with trigamma(y) = value; bisection on a scalar."""
    low, high = -18.0, 18.0
    for _ in range(200):
        middle = (low + high) / 2
        if float(trigamma(np.array([10.0**middle]))[0]) > value:
            low = middle
        else:
            high = middle
    return 10.0 ** ((low + high) / 2)


@F.pandas_udf(T.DoubleType())
def _t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float))).replace({np.nan: None}).astype("float64")


@F.pandas_udf(T.DoubleType())
def _f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    values = [v.to_numpy(dtype=float) for v in (f, df1, df2)]
    return pd.Series(f_upper(*values)).replace({np.nan: None}).astype("float64")


@F.pandas_udf(T.DoubleType())
def _digamma(x: pd.Series) -> pd.Series:
    return pd.Series(digamma(x.to_numpy(dtype=float)))


@F.pandas_udf(T.DoubleType())
def _trigamma(x: pd.Series) -> pd.Series:
    return pd.Series(trigamma(x.to_numpy(dtype=float)))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null or NaN in gives null out."""
    return F.nanvl(_t_p_value(t, df), F.lit(None).cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of an F statistic; null or NaN in gives null out."""
    return F.nanvl(_f_p_value(f, df1, df2), F.lit(None).cast("double"))


def digamma_column(x: Column) -> Column:
    return _digamma(x)


def trigamma_column(x: Column) -> Column:
    return _trigamma(x)
