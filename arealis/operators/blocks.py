"""Jobs in which each row meets all points: rows are dealt into chunks beside a copy of all points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

CHUNKS, LEAST_ROWS = 96, 256


def against_all(rows: DataFrame, points: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``solve(some rows, all points)`` as Arrow tables, a chunk of ``rows(id, ...)`` a
    task. The number of chunks has a limit, so what is shuffled and what a task holds grow
    as the points do; pairs exist only inside a task."""
    n = max(1, min(CHUNKS, rows.count() // LEAST_ROWS))
    left = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartition(n, "chunk")
    copy = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p_chunk"))
    names, nothing = ["p_chunk", *[f"p_{c}" for c in points.columns]], to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def run(some: pa.Table, every: pa.Table) -> pa.Table:
        if not some.num_rows or not every.num_rows:
            return nothing
        return solve(some, every.select(names).rename_columns([c.removeprefix("p_") for c in names]))

    return left.groupBy("chunk").cogroup(copy.repartition(n, "p_chunk").groupBy("p_chunk")).applyInArrow(run, schema)


def arrays(table: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns as arrays; a null among doubles is a nan."""
    return [table[c].to_numpy() for c in columns]


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that read it more than once."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() is not None else df.persist()
