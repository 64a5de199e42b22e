"""Column front door: a statistic for several columns of one table of nodes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_col(nodes: DataFrame, weights: DataFrame, columns: list[str], statistic: Callable[..., DataFrame], outvals: list[str], **options) -> DataFrame:
    """nodes with ``<column>_<value>`` for each column and wanted value of a statistic, a
    global one repeated on every row, a local one joined by id."""
    out = nodes
    for c in columns:
        found = statistic(nodes, weights, c, **options)
        named = [F.col(v).alias(f"{c}_{v}") for v in outvals]
        out = out.join(found.select("id", *named), "id", "left") if "id" in found.columns else out.crossJoin(F.broadcast(found.select(*named)))
    return out


def by_pair(nodes: DataFrame, weights: DataFrame, xs: list[str], ys: list[str], statistic: Callable[..., DataFrame], **options) -> DataFrame:
    """(x, y, ...) rows of a bivariate global statistic for all pairs of different columns."""
    rows = [statistic(nodes, weights, x, y, **options).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "*") for x in xs for y in ys if x != y]
    return reduce(DataFrame.unionByName, rows)
