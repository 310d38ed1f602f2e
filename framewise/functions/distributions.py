"""Distribution tails for test statistics (SciPy is not available).

Applied to already-aggregated rows only (one row per test), through an
Arrow-batched pandas UDF so the result stays a lazy DataFrame column.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 10_000):
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
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float | None, dof: float | None) -> float | None:
    """P(|T| >= |t|) for Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or not math.isfinite(dof) or dof <= 0 or t != t:
        return None
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_1df_p(chi2: float | None) -> float | None:
    """Upper tail of chi-squared with one degree of freedom."""
    if chi2 is None or chi2 != chi2 or chi2 < 0:
        return None
    return math.erfc(math.sqrt(chi2 / 2.0))


def normal_ppf(p: float) -> float:
    """Inverse standard normal CDF (Acklam's rational approximation + one Newton step)."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
    plow = 0.02425
    if p < plow:
        qq = math.sqrt(-2 * math.log(p))
        x = (((((c[0] * qq + c[1]) * qq + c[2]) * qq + c[3]) * qq + c[4]) * qq + c[5]) / \
            ((((d[0] * qq + d[1]) * qq + d[2]) * qq + d[3]) * qq + 1)
    elif p > 1 - plow:
        qq = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0] * qq + c[1]) * qq + c[2]) * qq + c[3]) * qq + c[4]) * qq + c[5]) / \
            ((((d[0] * qq + d[1]) * qq + d[2]) * qq + d[3]) * qq + 1)
    else:
        qq = p - 0.5
        r = qq * qq
        x = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * qq / \
            (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    e = 0.5 * math.erfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b))
                      for a, b in zip(t, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2_p_udf(x: pd.Series) -> pd.Series:
    return pd.Series([chi2_1df_p(None if pd.isna(a) else float(a)) for a in x], dtype="float64")


def t_pvalue(t: Column, dof: Column) -> Column:
    return _t_p_udf(t, dof)


def chi2_pvalue(chi2: Column) -> Column:
    return _chi2_p_udf(chi2)
