"""Rates: standardisation, shrinkage and spatial smoothing of events e over population b."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.numeric import gamma_quantile, norm_ppf, poisson_cdf
from .weights import distance_pairs, lag, row_sums, transform


def _totals(nodes: DataFrame, e: str, b: str) -> DataFrame:
    return nodes.agg(F.sum(F.col(e).cast("double")).alias("te"), F.sum(F.col(b).cast("double")).alias("tb"), F.count("*").cast("double").alias("n"))


def flatten_ids(nodes: DataFrame, lists: str, unique: bool = True) -> DataFrame:
    """(id) of all members of an array column, once each with ``unique``."""
    out = nodes.select(F.explode(lists).alias("id"))
    return out.distinct() if unique else out


def weighted_median(values: DataFrame, d: str, w: str) -> DataFrame:
    """One row, ``median``: the first value at which the cumulative weight reaches half the
    total; exactly half takes the mean with the next. Equal values are summed first, so
    the ordered window runs over distinct values."""
    g = values.groupBy(F.col(d).cast("double").alias("d")).agg(F.sum(F.col(w).cast("double")).alias("w"))
    order = Window.orderBy("d")
    c = g.withColumn("cum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.lead("d").over(order)).crossJoin(F.broadcast(g.agg((F.sum("w") / 2).alias("half"))))
    first = F.min_by(F.struct("d", "after", (F.round(F.col("cum") - F.col("half"), 12) == 0).alias("tie")), "d")
    return c.where(F.round(F.col("cum") - F.col("half"), 12) >= 0).agg(first.alias("m")).select(F.when(F.col("m.tie") & F.col("m.after").isNotNull(), (F.col("m.d") + F.col("m.after")) / 2).otherwise(F.col("m.d")).alias("median"))


def sum_by_n(strata: DataFrame, d: str, w: str, region: str = "region") -> DataFrame:
    return strata.groupBy(region).agg(F.sum(F.col(d) * F.col(w)).alias("total"))


def crude_age_standardization(strata: DataFrame, e: str = "e", b: str = "b", region: str = "region") -> DataFrame:
    """(region, r): stratum rates weighted by the region's own population, which is the plain rate."""
    own = Window.partitionBy(region)
    parts = strata.withColumn("share", ratio(b, F.sum(b).over(own)))
    return parts.groupBy(region).agg(F.sum(ratio(e, b) * F.col("share")).alias("r"))


def direct_age_standardization(strata: DataFrame, e: str = "e", b: str = "b", s: str = "s", region: str = "region", alpha: float = 0.05) -> DataFrame:
    """(region, r, lower, upper): rates weighted by the standard population, with gamma
    confidence limits. A rate of 0 has lower limit 0 and the limit of its largest weight."""
    total = Window.partitionBy(region)
    x = strata.withColumn("wt", ratio(1, b) * ratio(s, F.sum(s).over(total)))
    g = x.groupBy(region).agg(F.sum(F.col(e) * F.col("wt")).alias("r"), F.sum(F.col(e) * F.pow("wt", 2)).alias("v"), F.max("wt").alias("k"))
    lower = gamma_quantile(alpha / 2, ratio(F.pow("r", 2), "v")) * ratio("v", "r")
    k = F.col("k")
    upper = gamma_quantile(1 - alpha / 2, ratio(F.pow(F.col("r") + k, 2), F.col("v") + k * k)) * ratio(F.col("v") + k * k, F.col("r") + k)
    return g.select(region, "r", F.coalesce(lower, F.lit(0.0)).alias("lower"), upper.alias("upper"))


def standardized_mortality_ratio(strata: DataFrame, e: str = "e", b: str = "b", s_e: str = "s_e", s_b: str = "s_b", region: str = "region") -> DataFrame:
    return strata.groupBy(region).agg(ratio(F.sum(e), F.sum(F.col(b) * ratio(s_e, s_b))).alias("smr"))


def indirect_age_standardization(strata: DataFrame, e: str = "e", b: str = "b", s_e: str = "s_e", s_b: str = "s_b", region: str = "region", alpha: float = 0.05) -> DataFrame:
    """(region, r, lower, upper): mortality ratio times the standard's overall rate; limits
    are log-normal with standard error 1 / sqrt(events). The standard's overall rate is that
    of all rows together."""
    z = norm_ppf(1 - alpha / 2)
    g = strata.groupBy(region).agg(
        ratio(F.sum(e), F.sum(F.col(b) * ratio(s_e, s_b))).alias("smr"), F.sum(e).cast("double").alias("events")
    ).crossJoin(F.broadcast(strata.agg(ratio(F.sum(s_e), F.sum(s_b)).alias("std"))))
    half = z * ratio(1, F.sqrt("events"))
    r = F.col("smr") * F.col("std")
    return g.select(region, r.alias("r"), (F.exp(F.log("smr") - half) * F.col("std")).alias("lower"), (F.exp(F.log("smr") + half) * F.col("std")).alias("upper"))


def choynowski(strata: DataFrame, e: str = "e", b: str = "b", region: str = "region", threshold: float | None = None) -> DataFrame:
    """(region, p): Poisson tail of the events given the overall rate; with ``threshold``
    what is not below it becomes 0."""
    g = strata.groupBy(region).agg(F.sum(e).cast("double").alias("x"), F.sum(b).cast("double").alias("pop"))
    t = g.agg(F.sum("x").alias("te"), F.sum("pop").alias("tb"))
    c = g.crossJoin(F.broadcast(t)).withColumn("m", F.col("pop") * ratio("te", "tb"))
    p = F.when(F.col("x") <= F.col("m"), poisson_cdf(F.col("x"), F.col("m"))).otherwise(1 - poisson_cdf(F.col("x") - 1, F.col("m")))
    out = c.select(region, p.alias("p"))
    return out if threshold is None else out.withColumn("p", F.when(F.col("p") < threshold, F.col("p")).otherwise(0.0))


def _shrinkage(nodes: DataFrame, e: str, b: str) -> DataFrame:
    """Add y, m (overall rate) and a (between-area variance)."""
    d = nodes.crossJoin(F.broadcast(_totals(nodes, e, b))).withColumn("y", ratio(e, b)).withColumn("m", ratio("te", "tb"))
    s = d.agg(F.sum(F.col(b) * F.pow(F.col("y") - F.col("m"), 2)).alias("ss"))
    return d.crossJoin(F.broadcast(s)).withColumn("a", ratio("ss", "tb") - ratio("m", F.col("tb") / F.col("n")))


def assuncao_rate(nodes: DataFrame, e: str = "e", b: str = "b") -> DataFrame:
    """Add r: rates standardised by their empirical-Bayes variance."""
    d = _shrinkage(nodes, e, b)
    own = ratio("m", b)
    v = F.when(F.col("a") + own < 0, own).otherwise(F.col("a") + own)
    return d.withColumn("r", ratio(F.col("y") - F.col("m"), F.sqrt(v))).select(*nodes.columns, "r")


def excess_risk(nodes: DataFrame, e: str = "e", b: str = "b") -> DataFrame:
    d = nodes.crossJoin(F.broadcast(_totals(nodes, e, b)))
    return d.withColumn("r", ratio(e, F.col(b) * ratio("te", "tb"))).select(*nodes.columns, "r")


def empirical_bayes(nodes: DataFrame, e: str = "e", b: str = "b") -> DataFrame:
    """Add r: rates shrunk towards the overall rate; the variance is not floored."""
    d = _shrinkage(nodes, e, b)
    w = ratio("a", F.col("a") + ratio("m", b))
    return d.withColumn("r", w * F.col("y") + (1 - w) * F.col("m")).select(*nodes.columns, "r")


def spatial_rate(nodes: DataFrame, weights: DataFrame, e: str = "e", b: str = "b") -> DataFrame:
    """Add r: events over population of a site and its neighbours."""
    d = lag(nodes, transform(weights, "b"), __le=lambda w: w * F.col(f"n.{e}"), __lb=lambda w: w * F.col(f"n.{b}"))
    return d.withColumn("r", ratio(F.col(e) + F.col("__le"), F.col(b) + F.col("__lb"))).select(*nodes.columns, "r")


def spatial_empirical_bayes(nodes: DataFrame, weights: DataFrame, e: str = "e", b: str = "b") -> DataFrame:
    """Add r: rates shrunk towards the local rate by a local variance, floored at 0. The
    local population uses the weights as given, the local rate binary ones."""
    d = spatial_rate(nodes, weights, e, b).withColumnRenamed("r", "m").withColumn("y", ratio(e, b))
    near = weights.select("focal", "neighbor").unionByName(d.select(F.col("id").alias("focal"), F.col("id").alias("neighbor")))
    means = d.select(F.col("id").alias("focal"), "m")
    terms = near.join(means, "focal").join(d.select(F.col("id").alias("neighbor"), F.col("y").alias("yk"), F.col(b).alias("bk")), "neighbor")
    v = terms.groupBy(F.col("focal").alias("id")).agg(F.sum(F.col("bk") * F.pow(F.col("yk") - F.col("m"), 2)).alias("ss"), F.count("*").alias("k"))
    pop = lag(nodes, weights, __lb=lambda w: w * F.col(f"n.{b}")).select("id", (F.col("__lb") + F.col(b)).alias("pop"))
    x = d.join(v, "id").join(pop, "id")
    s2 = F.greatest(ratio("ss", "pop") - ratio("m", ratio("pop", "k")), F.lit(0.0))
    return x.withColumn("r", F.col("m") + (F.col("y") - F.col("m")) * ratio(s2, s2 + ratio("m", b))).select(*nodes.columns, "r")


def kernel_smoother(nodes: DataFrame, weights: DataFrame, e: str = "e", b: str = "b") -> DataFrame:
    """Add r: kernel-weighted events over kernel-weighted population."""
    d = lag(nodes, weights, __le=lambda w: w * F.col(f"n.{e}"), __lb=lambda w: w * F.col(f"n.{b}"))
    return d.withColumn("r", ratio("__le", "__lb")).select(*nodes.columns, "r")


def age_adjusted_smoother(strata: DataFrame, weights: DataFrame, e: str = "e", b: str = "b", s: str = "s", alpha: float = 0.05) -> DataFrame:
    """(region, r, lower, upper): strata (region, stratum, e, b, s) are summed over each
    region's neighbours, itself by its self-weight only, then standardised directly."""
    edges = weights.select(F.col("focal").alias("region"), F.col("neighbor"), "weight")
    near = edges.join(strata.select(F.col("region").alias("neighbor"), "stratum", F.col(e).alias("ne"), F.col(b).alias("nb")), "neighbor")
    sums = near.groupBy("region", "stratum").agg(F.sum(F.col("weight") * F.col("ne")).alias("e"), F.sum(F.col("weight") * F.col("nb")).alias("b"))
    return direct_age_standardization(sums.join(strata.select("region", "stratum", F.col(s).alias("s")), ["region", "stratum"]), alpha=alpha)


def disk_smoother(nodes: DataFrame, weights: DataFrame, e: str = "e", b: str = "b") -> DataFrame:
    """Add r: weighted mean of the neighbours' rates, the site itself left out."""
    d = lag(row_sums(nodes.withColumn("__y", ratio(e, b)), weights), weights, __l="__y")
    return d.withColumn("r", ratio("__l", "wsum")).select(*nodes.columns, "r")


def spatial_median_rate(nodes: DataFrame, weights: DataFrame, e: str = "e", b: str = "b", aw: str | None = None, iterations: int = 1) -> DataFrame:
    """Add r: the median of rates over a site and its neighbours, again ``iterations``
    times; with ``aw`` weighted by that column."""
    near = weights.select("focal", "neighbor").unionByName(nodes.select(F.col("id").alias("focal"), F.col("id").alias("neighbor")))
    cur = nodes.select("id", ratio(e, b).alias("y"), (F.col(aw) if aw else F.lit(1.0)).cast("double").alias("a"))
    for _ in range(iterations):
        rows = near.join(cur.withColumnRenamed("id", "neighbor"), "neighbor")
        if aw is None:
            med = rows.groupBy(F.col("focal").alias("id")).agg(F.median("y").alias("y"))
        else:
            order = Window.partitionBy("focal").orderBy("y", "neighbor")
            c = rows.withColumn("cum", F.sum("a").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("half", F.sum("a").over(Window.partitionBy("focal")) / 2).withColumn("after", F.lead("y").over(order))
            m = F.min_by(F.struct("y", "after", (F.col("cum") == F.col("half")).alias("tie")), F.struct("y", "neighbor"))
            med = c.where("cum >= half").groupBy(F.col("focal").alias("id")).agg(m.alias("m")).select("id", F.when(F.col("m.tie") & F.col("m.after").isNotNull(), (F.col("m.y") + F.col("m.after")) / 2).otherwise(F.col("m.y")).alias("y"))
        cur = med.join(cur.select("id", "a"), "id")
    return nodes.join(cur.select("id", F.col("y").alias("r")), "id", "left")


def spatial_filtering(points: DataFrame, bbox: tuple[tuple[float, float], tuple[float, float]], x_grid: int, y_grid: int, e: str = "e", b: str = "b", r: float | None = None, pop: float | None = None) -> DataFrame:
    """(gx, gy, rate, by): rates around the centres of a grid whose upper bounds are left
    out, within radius ``r`` and / or of the nearest points up to a population ``pop``, one
    at least. Points (id, x, y, e, b)."""
    if r is None and pop is None:
        raise ValueError("give r or pop")
    (x0, y0), (x1, y1) = bbox
    spark = points.sparkSession
    grid = spark.range(x_grid * y_grid).select(
        F.col("id").alias("g"), (F.lit(float(x0)) + F.expr(f"id div {y_grid}") * ((x1 - x0) / x_grid)).alias("gx"), (F.lit(float(y0)) + (F.col("id") % y_grid) * ((y1 - y0) / y_grid)).alias("gy")
    )
    parts = []
    if r is not None:
        both = points.select("id", "x", "y").unionByName(grid.select((-1 - F.col("g")).alias("id"), F.col("gx").alias("x"), F.col("gy").alias("y")))
        near = distance_pairs(both, r).where("focal < 0 and neighbor >= 0").select((-1 - F.col("focal")).alias("g"), F.col("neighbor").alias("id"))
        parts.append(near.join(points.select("id", e, b), "id").groupBy("g").agg(ratio(F.sum(e), F.sum(b)).alias("rate")).withColumn("by", F.lit("radius")))
    if pop is not None:
        d = F.sqrt(F.pow(F.col("x") - F.col("gx"), 2) + F.pow(F.col("y") - F.col("gy"), 2))
        rows = points.crossJoin(F.broadcast(grid.select("g", "gx", "gy"))).select("g", "id", e, b, d.alias("d"))  # the grid's size is a parameter
        order = Window.partitionBy("g").orderBy("d", "id")
        taken = rows.withColumn("cum", F.sum(b).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order)).where((F.col("cum") <= pop) | (F.col("k") == 1))
        parts.append(taken.groupBy("g").agg(ratio(F.sum(e), F.sum(b)).alias("rate")).withColumn("by", F.lit("population")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.join(grid, "g").select("gx", "gy", "rate", "by")
