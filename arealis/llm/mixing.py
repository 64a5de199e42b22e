"""Mixing sources to target weights by proportionate-fair scheduling.

Each source's documents are dealt into blocks of about equal text. Block j of a source
with weight w may run from slot floor(j / w) and must have run by slot ceil((j + 1) / w).
Earliest deadline first over these windows meets every deadline when the weights sum to 1,
so at every slot each source is less than one block away from its exact share. With
weights in units of 1 / period the schedule repeats after ``period`` slots: one period,
whose length is a parameter, is planned on the driver, and each block finds its slot by
division. Native: DataFrame functions only.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

PERIOD = 4096
BLOCK_CHARS = 65536


def target_units(sizes: dict[str, int], period: int = PERIOD, weights: dict[str, float] | None = None) -> dict[str, int]:
    """Slots of each source in a period, at least one each, by largest remainders. Without
    ``weights`` a source weighs the square root of its text, which lifts small sources."""
    names = sorted(sizes)
    if len(names) > period:
        raise ValueError(f"{len(names)} sources do not fit a period of {period} slots")
    raw = {s: int((weights[s] if weights else sizes[s] ** 0.5) * 1024) for s in names}
    total, free = sum(raw.values()), period - len(names)
    if not total:
        raw, total = dict.fromkeys(names, 1), len(names)
    units = {s: 1 + free * raw[s] // total for s in names}
    order = sorted(names, key=lambda s: (-(free * raw[s] % total), s))
    for s in order[: period - sum(units.values())]:
        units[s] += 1
    return units


def plan_period(units: dict[str, int]) -> dict[str, list[int]]:
    """Source -> slots of its blocks in one period, by earliest deadline first; ties by name."""
    period = sum(units.values())
    waiting = [(0, s, 0) for s in sorted(units) if units[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in units}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // units[s]), s, j))
        deadline, s, j = heapq.heappop(ready)
        assert slot < deadline
        out[s].append(slot)
        if j + 1 < units[s]:
            heapq.heappush(waiting, ((j + 1) * period // units[s], s, j + 1))
    return out


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block_chars: int = BLOCK_CHARS, seed: int = 42) -> DataFrame:
    """(doc_id, source, block, slot, place) for each row of ``docs(doc_id, text, source)``.

    Sorted by slot and then place, the rows are the mixture. Within a source the order is
    that of md5(seed:doc_id); ``place`` is the text of the source before a document, in
    characters, and ``block`` is place div ``block_chars``. Every row is kept: a source
    that has run out leaves its slots to nobody, and the others keep their proportions.

    A null source is a source of its own, the empty string; a null doc_id counts as the
    empty string in the order; a null text has no characters and shares its predecessor's
    place. Repeated rows stand side by side. An empty table gives an empty result; other
    columns are ignored. Places are sums of sums: of 4096 parts of a source by hash, then
    of the parts before, so no task gets a whole source.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("turn"),
    ).withColumn("part", F.substring("turn", 1, 3))
    rows = cut(rows, "mixing")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    plan = plan_period(target_units(sizes, period, weights)) if sizes else {}
    table = (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(json.dumps(plan)), "map<string, array<int>>")).alias("source", "slots"))
        .select("source", "slots", F.size("slots").cast("long").alias("units"))
    )
    earlier = Window.partitionBy("source", "part").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("within", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(parts, ["source", "part"])
        .withColumn("place", F.col("base") + F.col("within"))
        .withColumn("block", F.expr(f"place div {block_chars}"))
    )
    slot = F.expr(f"(block div units) * {period} + slots[cast(block % units as int)]").cast("long")
    return placed.join(F.broadcast(table), "source").select("doc_id", "source", "block", slot.alias("slot"), "place")  # `period` numbers in all


def placed_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with two more columns, ``slot`` and ``place``; sorted by them, the rows are
    the mixture. Repeated rows have the first place of theirs."""
    mixed = mix_sources(docs, weights).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("at"))
    mixed = mixed.select(F.col("doc_id").alias("__id"), F.col("at.slot").alias("slot"), F.col("at.place").alias("place"))
    return docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["__id"])).drop("__id")


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` in the order of the mixture; all rows, columns as given. The order does not
    outlive writing and reading: ``placed_documents`` says it in columns."""
    return placed_documents(docs, weights).orderBy("slot", "place").select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents
), s AS (
  SELECT source, row_number() OVER (ORDER BY source) AS i, floor(sqrt(sum(size)::DOUBLE) * 1024)::BIGINT AS raw
  FROM d GROUP BY source
), w AS (
  SELECT *, ({PERIOD} - count(*) OVER ()) AS free, sum(raw) OVER () AS total FROM s
), u AS (
  SELECT source, i, 1 + (free * raw) // total AS base, row_number() OVER (ORDER BY (free * raw) % total DESC, source) AS r,
         {PERIOD} - sum(1 + (free * raw) // total) OVER () AS rest
  FROM w
), units AS (
  SELECT source, i, (base + CASE WHEN r <= rest THEN 1 ELSE 0 END)::BIGINT AS n FROM u
), lists AS (
  SELECT list(n ORDER BY i) AS n FROM units
), edf AS (
  SELECT -1::BIGINT AS slot, -1::BIGINT AS i, -1::BIGINT AS j, list_transform(n, lambda x: 0::BIGINT) AS next, n FROM lists
  UNION ALL
  SELECT slot + 1, best, next[best], list_transform(next, lambda x, k: CASE WHEN k = best THEN x + 1 ELSE x END), n
  FROM (
    SELECT slot, next, n, list_min(list_transform(next, lambda x, k:
      CASE WHEN x < n[k] AND (x * {PERIOD}) // n[k] <= slot + 1
           THEN (((x + 1) * {PERIOD} + n[k] - 1) // n[k]) * 100000 + k ELSE 9000000000000 END)) % 100000 AS best
    FROM edf WHERE slot < {PERIOD} - 1
  )
), placed AS (
  SELECT doc_id, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d
)
SELECT doc_id, placed.source AS source, place // {BLOCK_CHARS} AS block, ((place // {BLOCK_CHARS}) // n) * {PERIOD} + slot AS slot, place
FROM placed JOIN units ON units.source = placed.source
JOIN (SELECT slot, i, j FROM edf WHERE slot >= 0) e ON e.i = units.i AND e.j = (place // {BLOCK_CHARS}) % n
"""
