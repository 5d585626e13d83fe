"""Tail probabilities of the chi-square, t, F and normal distributions.

scipy is not available, so the regularised incomplete gamma and beta functions are
evaluated here (series / continued fractions with ``math.lgamma``).  They only ever
run on small result tables (one row per pair or per test), wrapped as Arrow-batched
pandas UDFs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_MAXIT = 500


def _gamma_p_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(_MAXIT):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_q_cf(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, _MAXIT):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        if abs(d) < tiny:
            d = tiny
        c = b + an / c
        if abs(c) < tiny:
            c = tiny
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return max(0.0, 1.0 - _gamma_p_series(a, x))
    return _gamma_q_cf(a, x)


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    if abs(d) < tiny:
        d = tiny
    d = 1.0 / d
    h = d
    for m in range(1, _MAXIT):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _beta_cf(a, b, x) / a
    return 1.0 - bt * _beta_cf(b, a, 1.0 - x) / b


def chi2_sf(stat: float, dof: float) -> float:
    if stat is None or dof is None or not np.isfinite(stat) or dof <= 0:
        return float("nan")
    return gamma_q(dof / 2.0, stat / 2.0)


def t_two_sided(t: float, dof: float) -> float:
    if t is None or dof is None or dof <= 0 or not np.isfinite(dof):
        return float("nan")
    if not np.isfinite(t):
        return 0.0
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0:
        return float("nan")
    if not np.isfinite(f):
        return 0.0 if f > 0 else float("nan")
    if f <= 0:
        return 1.0
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _vec(fn, *cols: pd.Series) -> pd.Series:
    out = []
    for vals in zip(*cols):
        if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals):
            out.append(None)
        else:
            r = fn(*[float(v) for v in vals])
            out.append(None if r is None or math.isnan(r) else r)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2_sf_udf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return _vec(chi2_sf, stat, dof)


@F.pandas_udf(T.DoubleType())
def _t_two_sided_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _vec(t_two_sided, t, dof)


@F.pandas_udf(T.DoubleType())
def _f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_sf, f, d1, d2)


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    """P(X >= stat) for X ~ chi-square(dof); for small result tables."""
    return _chi2_sf_udf(stat.cast("double"), dof.cast("double"))


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return _t_two_sided_udf(t.cast("double"), dof.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return _f_sf_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def corr_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson r on n points (t = r*sqrt((n-2)/(1-r^2)))."""
    t = r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    return F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(t_pvalue(t, n - 2))
