"""Tail probabilities that Spark lacks, as Arrow-batched functions over columns.

Each takes doubles; a null or NaN argument, or a degree of freedom that is not
positive, gives null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _steps(size: np.ndarray) -> int:
    """Terms that a series needs at most: near its mode some ten times the square root of the degrees of freedom."""
    return 500 + int(20 * math.sqrt(max(1.0, float(np.max(np.where(np.isfinite(size), size, 1), initial=1)))))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz), for x below (a + 1) / (a + b + 2)."""
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    out = d.copy()
    for m in range(1, _steps(a + b)):
        for even in (True, False):
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 + step * d, 1 + step / c
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = np.where(np.abs(c) < TINY, TINY, c)
            out = out * d * c
        if not np.any(np.abs(d * c - 1) >= 1e-14):
            return out
    raise ArithmeticError("incomplete beta function: no convergence")


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    # where x is above, the other tail converges
    near, far = np.where(low, a, b), np.where(low, b, a)
    part = front * _fraction(near, far, np.where(low, inner, 1 - inner)) / near
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, part, 1 - part)))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    inner = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(inner) - inner - _LGAMMA(a))
    low = inner < a + 1
    return np.where(x <= 0, 1.0, np.where(low, 1 - front * _series(a, np.where(low, inner, a)), front * _upper(a, np.where(low, a + 1, inner))))


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = total = 1 / a
    for n in range(1, _steps(a)):
        term = term * x / (a + n)
        total = total + term
        if not np.any(np.abs(term) > np.abs(total) * 1e-16):
            return total
    raise ArithmeticError("incomplete gamma function: no convergence")


def _upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    b = x + 1 - a
    c, d = np.full_like(x, 1 / TINY), 1 / np.where(np.abs(b) < TINY, TINY, b)
    h = d.copy()
    for n in range(1, _steps(a)):
        an = -n * (n - a)
        b = b + 2
        d, c = an * d + b, b + an / c
        d, c = 1 / np.where(np.abs(d) < TINY, TINY, d), np.where(np.abs(c) < TINY, TINY, c)
        h = h * d * c
        if not np.any(np.abs(d * c - 1) >= 1e-14):
            return h
    raise ArithmeticError("incomplete gamma function: no convergence")


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_upper(df / 2, x / 2)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return gamma_upper(np.full(len(z), 0.5), z * z / 2)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """z with upper tail p / 2, by Newton steps from a rational start; at most 38."""
    p = np.clip(np.asarray(p, float), 1e-300, 1.0)
    t = np.sqrt(-2 * np.log(np.minimum(p / 2, 0.5)))
    z = np.maximum(t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t), 0)
    for _ in range(6):
        density = np.exp(-z * z / 2) * np.sqrt(2 / np.pi)
        step = (normal_two_sided(z) - p) / np.maximum(density, 1e-300)
        z = np.maximum(z + np.clip(step, -1, 1), 0)
    return np.minimum(z, 38.0)


def _column(f, n_df: int):
    def run(*s: pd.Series) -> pd.Series:
        values = [x.to_numpy(float, na_value=np.nan) for x in s]
        ok = np.all([np.isfinite(v) for v in values], axis=0)
        for v in values[1:]:
            ok &= v > 0
        out = np.full(len(values[0]), np.nan)
        if ok.any():
            out[ok] = f(*(v[ok] for v in values))
        return pd.Series(out).astype("Float64")

    def one(x: pd.Series) -> pd.Series:
        return run(x)

    def two(x: pd.Series, a: pd.Series) -> pd.Series:
        return run(x, a)

    def three(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return run(x, a, b)

    return F.pandas_udf((one, two, three)[n_df], "double")


def t_p(t: Column, df: Column) -> Column:
    return _column(t_two_sided, 1)(t.cast("double"), df.cast("double"))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_upper, 2)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    return _column(chi2_upper, 1)(x.cast("double"), df.cast("double"))


def normal_p(z: Column) -> Column:
    return _column(normal_two_sided, 0)(z.cast("double"))


def z_of_p(p: Column) -> Column:
    return _column(normal_quantile, 0)(p.cast("double"))


def signed_log(p: Column, sign: Column) -> Column:
    """sign * -ln p, with 100 for p = 0."""
    return sign * F.when(p == 0, 100.0).otherwise(-F.ln(p))
