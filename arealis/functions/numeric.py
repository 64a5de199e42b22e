"""Distribution functions in NumPy, as pandas UDFs where SQL has no closed form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if not (x > 0 and a > 0):
        return 0.0 if x <= 0 else math.nan
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return total * front
    # Modified Lentz evaluation of the continued fraction of the upper function.
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def gamma_ppf(p: float, a: float, scale: float = 1.0) -> float:
    """Quantile of the gamma distribution, by bisection to full precision."""
    if math.isnan(p) or math.isnan(a) or not a > 0:
        return math.nan
    lo, hi = 0.0, max(1.0, a)
    while gamma_p(a, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if gamma_p(a, mid) < p else (lo, mid)
    return (lo + hi) / 2 * scale


def norm_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def poisson_cdf_value(k: float, mean: float) -> float:
    return 1 - gamma_p(math.floor(k) + 1, mean) if k >= 0 else 0.0


def _udf(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if x is not None and y is not None and x == x and y == y else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def chi2_sf(x: Column, dof: Column) -> Column:
    return _udf(lambda x, k: 1 - gamma_p(k / 2, x / 2))(x, dof)


def poisson_cdf(k: Column, mean: Column) -> Column:
    return _udf(poisson_cdf_value)(k.cast("double"), mean.cast("double"))


def gamma_quantile(p: float, shape: Column) -> Column:
    return _udf(lambda a, _: gamma_ppf(p, a))(shape, F.lit(0.0))


def erfc_exact(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in np.atleast_1d(x)])
