"""Comparison of two maps of polygons by the entropy of their overlay."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import entr, ratio
from .geometry import area, clip_area


@F.pandas_udf(T.DoubleType())
def _clip(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([clip_area(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def overlay(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a_id, b_id, area) of all pairs whose boxes meet: boxes are dealt into cells, cells
    are joined, a pair is kept in the one cell that holds the lower left corner of its
    boxes' meeting, and only then clipped."""

    def boxed(d, k):
        x = F.flatten(F.transform("geom", lambda p: F.transform(p["shell"], lambda q: q["x"])))
        y = F.flatten(F.transform("geom", lambda p: F.transform(p["shell"], lambda q: q["y"])))
        e = d.select(F.col("id").alias(f"{k}_id"), F.col("geom").alias(f"{k}_g"), F.array_min(x).alias(f"{k}x0"), F.array_max(x).alias(f"{k}x1"), F.array_min(y).alias(f"{k}y0"), F.array_max(y).alias(f"{k}y1"))
        at = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("long")
        return e.withColumn("cx", F.explode(F.sequence(at(f"{k}x0"), at(f"{k}x1")))).withColumn("cy", F.explode(F.sequence(at(f"{k}y0"), at(f"{k}y1"))))

    both = boxed(a, "a").join(boxed(b, "b"), ["cx", "cy"]).where("ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1")
    corner = lambda p, q: F.floor(F.greatest(p, q) / F.lit(float(cell))).cast("long")
    once = both.where((F.col("cx") == corner("ax0", "bx0")) & (F.col("cy") == corner("ay0", "by0")))
    return once.select("a_id", "b_id", _clip("a_g", "b_g").alias("area"))


def areal_entropy(polygons: DataFrame, base: float = math.e, local: bool = False) -> DataFrame:
    """Entropy of the shares of area: one row, or each polygon's part."""
    d = polygons.select("id", area(F.col("geom")).alias("a"))
    parts = d.crossJoin(F.broadcast(d.agg(F.sum("a").alias("t")))).select("id", (entr(ratio("a", "t")) / math.log(base)).alias("entropy"))
    return parts if local else parts.agg(F.sum("entropy").alias("entropy"))


def overlay_entropy(a: DataFrame, b: DataFrame, cell: float, standardize: bool = True, local: bool = False, base: float = math.e) -> DataFrame:
    """How mixed b is within each polygon of a: entropies of the shares of overlap,
    divided by b's own areal entropy if ``standardize``."""
    share = overlay(a, b, cell).join(a.select(F.col("id").alias("a_id"), area(F.col("geom")).alias("t")), "a_id")
    e = share.groupBy(F.col("a_id").alias("id")).agg(F.greatest(F.sum(entr(F.greatest(ratio("area", "t"), F.lit(0.0)))), F.lit(0.0)).alias("entropy"))
    e = a.select("id").join(e, "id", "left").select("id", (F.coalesce("entropy", F.lit(0.0)) / math.log(base)).alias("entropy"))
    if standardize:
        e = e.crossJoin(F.broadcast(areal_entropy(b, base).withColumnRenamed("entropy", "own"))).select("id", ratio("entropy", "own").alias("entropy"))
    return e if local else e.agg(F.sum("entropy").alias("entropy"))


def completeness(a: DataFrame, b: DataFrame, cell: float, local: bool = False) -> DataFrame:
    """1 less the area-weighted standardised overlay entropy of b within a."""
    e = overlay_entropy(a, b, cell, local=True).join(a.select("id", area(F.col("geom")).alias("a")), "id")
    parts = e.crossJoin(F.broadcast(e.agg(F.sum("a").alias("t")))).select("id", (ratio("a", "t") * (1 - F.col("entropy"))).alias("completeness"))
    return parts if local else parts.agg(F.sum("completeness").alias("completeness"))


def homogeneity(a: DataFrame, b: DataFrame, cell: float, local: bool = False) -> DataFrame:
    """Completeness with the maps' roles exchanged."""
    return completeness(b, a, cell, local).withColumnRenamed("completeness", "homogeneity")


def external_entropy(a: DataFrame, b: DataFrame, cell: float, balance: float = 0.0) -> DataFrame:
    """One row, ``v``: the harmonic balance of homogeneity and completeness; a larger
    ``balance`` favours completeness."""
    beta = math.exp(balance)
    both = completeness(a, b, cell).crossJoin(F.broadcast(homogeneity(a, b, cell)))
    h, c = F.col("homogeneity"), F.col("completeness")
    return both.select(ratio((1 + beta) * h * c, beta * h + c).alias("v"))
