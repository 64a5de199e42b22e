"""Non-parametric Poisson mixture smoothing of rates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pmf(e: np.ndarray, b: np.ndarray, rates: np.ndarray) -> np.ndarray:
    mean = np.maximum(b[:, None] * rates, 1e-300)
    logs = np.array([math.lgamma(x + 1) for x in e])
    return np.exp(e[:, None] * np.log(mean) - mean - logs[:, None])


def fit_mixture(e: np.ndarray, b: np.ndarray, n: np.ndarray, k: int = 50, acc: float = 1e-7, rounds: int = 5000, limit: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Rates and weights of the mixture's components for events ``e`` over population
    ``b`` seen ``n`` times each.

    Weights over an even grid of k rates move by vertex exchange until no rate's gradient
    exceeds 1 by ``acc``; rates with a weight over 0.001 stay; EM refines both; neighbours
    closer than ``limit`` are merged and refined once more."""
    w = n / n.sum()
    raw = e / b
    rates = np.linspace(raw.min(), raw.max(), k)
    p = np.full(k, 1.0 / k)
    f = _pmf(e, b, rates)

    def gradient(f, p):
        return (w[:, None] * f / np.maximum(f @ p, 1e-300)[:, None]).sum(0)

    for _ in range(rounds):
        g = gradient(f, p)
        hi, lo = int(g.argmax()), int(np.where(p > 1e-8, g, np.inf).argmin())
        if g[hi] - 1 < acc or hi == lo:
            break
        h, mix, step = (f[:, hi] - f[:, lo]) * p[lo], f @ p, 0.0
        for _ in range(50):  # Newton's method on the concave likelihood along the exchange
            q = h / np.maximum(mix + step * h, 1e-300)
            d1, d2 = (w * q).sum(), -(w * q * q).sum()
            new = min(max(step - d1 / d2, 0.0), 1.0) if d2 else step
            if abs(new - step) < 1e-12:
                break
            step = new
        moved = step * p[lo]
        p[lo] -= moved
        p[hi] += moved
    keep = p > 1e-3
    rates, p = rates[keep], p[keep] / p[keep].sum()

    def em(rates, p, rounds):
        for i in range(rounds):
            f = _pmf(e, b, rates)
            r = w[:, None] * f * p / np.maximum(f @ p, 1e-300)[:, None]
            g = gradient(f, p)
            p = r.sum(0)
            rates = (r * e[:, None]).sum(0) / np.maximum((r * b[:, None]).sum(0), 1e-300)
            if abs(g.max() - 1) < acc and i > 10:
                break
        return rates, p

    rates, p = em(rates, p, rounds)
    order = np.argsort(rates)
    rates, p = rates[order], p[order]
    group = np.concatenate([[0], np.cumsum(np.diff(rates) >= limit)])
    if group[-1] + 1 < len(rates):
        first = np.concatenate([[True], np.diff(group) > 0])
        rates, p = em(rates[first], np.bincount(group, p), 1)
    return rates, p


def mixture_smoother(nodes: DataFrame, e: str = "e", b: str = "b", k: int = 50, limit: float = 0.01) -> DataFrame:
    """Add r, the posterior mean rate, and category, the likeliest component (by rate).
    The fit sees distinct (e, b) with their counts, in one task; it is joined back."""
    pairs = nodes.groupBy(F.col(e).cast("double").alias("__e"), F.col(b).cast("double").alias("__b")).agg(F.count("*").alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__e", "__b"])
        x, y = pdf["__e"].to_numpy(float), pdf["__b"].to_numpy(float)
        rates, p = fit_mixture(x, y, pdf["n"].to_numpy(float), k, limit=limit)
        post = _pmf(x, y, rates) * p
        return pd.DataFrame({"__e": x, "__b": y, "r": post @ rates / post.sum(1), "category": post.argmax(1)})

    fitted = pairs.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "__e double, __b double, r double, category int")
    keyed = nodes.withColumns({"__e": F.col(e).cast("double"), "__b": F.col(b).cast("double")})
    return keyed.join(fitted, ["__e", "__b"], "left").select(*nodes.columns, "r", "category")
