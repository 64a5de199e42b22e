"""Column builders shared by the operators. Ratios give null where NumPy would give inf or nan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation 7.1.26 of Abramowitz and Stegun, |error| < 1.5e-7.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def norm_sf(z: Column | str) -> Column:
    """P(Z > z) of a standard normal variable."""
    z = col(z)
    p, a1, a2, a3, a4, a5 = ERF
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * x)
    tail = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def norm_cdf(z: Column | str) -> Column:
    return 1 - norm_sf(z)


def chi2_sf_1(x: Column | str) -> Column:
    """P(X > x) for chi-square with one degree of freedom."""
    return 2 * norm_sf(F.sqrt(col(x)))


def entr(p: Column | str) -> Column:
    """-p ln p; 0 at 0; minus infinity below."""
    p = col(p)
    return F.when(p > 0, -p * F.log(F.when(p > 0, p))).when(p == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))


def percentile_of(sorted_values: Column, p: Column) -> Column:
    """Linearly interpolated percentile (0-100) of a sorted array; p may be a column."""
    h = (F.size(sorted_values) - 1) * p / 100.0
    lo = F.floor(h).cast("int")
    hi = F.least(lo + 1, F.size(sorted_values) - 1)
    a, b = F.get(sorted_values, lo), F.get(sorted_values, hi)
    return a + (b - a) * (h - lo)


def p_of_counts(larger: Column, equal_or_less: Column, reps: Column | int, alternative: str) -> Column:
    """Pseudo p-value from counts of replicates at least and at most as large as observed."""
    reps = F.lit(reps) if isinstance(reps, int) else reps
    if alternative in ("directed", None):
        return (F.least(larger, reps - larger) + 1) / (reps + 1)
    if alternative == "greater":
        return (larger + 1) / (reps + 1)
    if alternative == "lesser":
        return (equal_or_less + 1) / (reps + 1)
    raise ValueError(f"alternative {alternative!r} needs the replicates: use p_of_array")


def p_of_array(observed: Column, sims: Column, alternative: str = "directed") -> Column:
    """Pseudo p-value of ``observed`` under an array of replicates, for all five
    alternatives: directed, greater, lesser, folded, two-sided."""
    n = F.size(sims)
    larger = F.size(F.filter(sims, lambda s: s >= observed))
    less = F.size(F.filter(sims, lambda s: s <= observed))
    if alternative in ("directed", "greater", "lesser", None):
        return p_of_counts(larger, less, n, alternative or "directed")
    if alternative == "folded":
        mean = F.aggregate(sims, F.lit(0.0), lambda a, s: a + s) / n
        far = F.size(F.filter(sims, lambda s: F.abs(s - mean) >= F.abs(observed - mean)))
        return (far + 1) / (n + 1)
    if alternative == "two-sided":
        ordered = F.array_sort(sims)
        share = less / n * 100
        low = F.least(share, 100 - share)
        lo, hi = percentile_of(ordered, low), percentile_of(ordered, 100 - low)
        out = F.size(F.filter(sims, lambda s: s <= lo)) + F.size(F.filter(sims, lambda s: s >= hi))
        return (out + 1) / (n + 1)
    raise ValueError(f"unknown alternative {alternative!r}")
