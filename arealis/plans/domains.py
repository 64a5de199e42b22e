"""Deterministic geographies over the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import weights as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Nations on a 5 x 5 lattice: y mean balance, x customers, e rich customers, b customers + 1.
def nation(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    g = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("y"), F.count("*").alias("x"), F.sum((F.col("c_acctbal") > 5000).cast("long")).alias("e"))
    j = n.join(g, "n_nationkey", "left")
    return j.select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("pos"), F.round(F.coalesce("y", F.lit(0.0)), 4).alias("y"), F.coalesce("x", F.lit(0)).cast("double").alias("x"),
        F.coalesce("e", F.lit(0)).cast("double").alias("e"), (F.coalesce("x", F.lit(0)) + 1).cast("double").alias("b"), F.col("n_regionkey").cast("int").alias("label"),
    )


NATION = """nodes AS (
  SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS pos, round(coalesce(avg(c_acctbal), 0), 4) AS y, count(c_custkey)::DOUBLE AS x,
         count(CASE WHEN c_acctbal > 5000 THEN 1 END)::DOUBLE AS e, (count(c_custkey) + 1)::DOUBLE AS b, any_value(n_regionkey)::INT AS label
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
)"""


def part(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"), (F.col("p_size") % 5).alias("label"))


PART = "nodes AS (SELECT p_partkey AS id, p_partkey AS pos, p_retailprice AS y, p_size::DOUBLE AS x, (p_size % 5)::INT AS label FROM part)"


def part_rates(spark: SparkSession, d: str) -> DataFrame:
    """e returned lines and b all lines + 1 of each part."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("e"), F.count("*").alias("b"))
    p = table(spark, d, "part").select("p_partkey").join(li, "p_partkey", "left")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), (F.coalesce("e", F.lit(0)) + 1).cast("double").alias("e"), (F.coalesce("b", F.lit(0)) + 2).cast("double").alias("b"))


PART_RATES = """nodes AS (
  SELECT p_partkey AS id, p_partkey AS pos, (count(CASE WHEN l_returnflag = 'R' THEN 1 END) + 1)::DOUBLE AS e, (count(l_orderkey) + 2)::DOUBLE AS b
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey
)"""


def binary(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers on a lattice of width 10 with three binary variables."""
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("pos"), (F.col("s_acctbal") > 4000).cast("int").alias("y"), (F.col("s_nationkey") % 3 > 0).cast("int").alias("x"), (F.col("s_suppkey") % 4 > 0).cast("int").alias("v")
    )


BINARY = "nodes AS (SELECT s_suppkey AS id, s_suppkey AS pos, (s_acctbal > 4000)::INT AS y, (s_nationkey % 3 > 0)::INT AS x, (s_suppkey % 4 > 0)::INT AS v FROM supplier)"


def all_points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    at = lambda i: F.round(F.col("embedding")[i].cast("double"), 6)
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (F.col("vec_id") % 7 + 1).cast("double").alias("e"), (F.col("vec_id") % 11 + 10).cast("double").alias("b"), "label")


POINTS = """nodes AS (
  SELECT vec_id AS id, vec_id AS pos, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z,
         (vec_id % 7 + 1)::DOUBLE AS e, (vec_id % 11 + 10)::DOUBLE AS b, label FROM embeddings
)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """Rows with two features, for silhouettes."""
    return all_points(spark, d).select("id", "label", F.array("x", "y").alias("features"))


def strata(spark: SparkSession, d: str) -> DataFrame:
    """(region, stratum, e, b, s, s_e, s_b): market segments of nations."""
    c = table(spark, d, "customer")
    g = c.groupBy(F.col("c_nationkey").cast("long").alias("region"), F.col("c_mktsegment").alias("stratum")).agg((F.sum((F.col("c_acctbal") > 5000).cast("long")) + 1).cast("double").alias("e"), (F.count("*") + 5).cast("double").alias("b"))
    s = c.groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count("*").cast("double").alias("s"), (F.sum((F.col("c_acctbal") > 5000).cast("long")) + 1).cast("double").alias("s_e"), (F.count("*") + 5).cast("double").alias("s_b"))
    return g.join(s, "stratum").select("region", "stratum", "e", "b", "s", "s_e", "s_b")


STRATA = """strata AS (
  SELECT g.*, s, s_e, s_b FROM (
    SELECT c_nationkey::BIGINT AS region, c_mktsegment AS stratum, (count(CASE WHEN c_acctbal > 5000 THEN 1 END) + 1)::DOUBLE AS e, (count(*) + 5)::DOUBLE AS b FROM customer GROUP BY ALL
  ) g JOIN (
    SELECT c_mktsegment AS stratum, count(*)::DOUBLE AS s, (count(CASE WHEN c_acctbal > 5000 THEN 1 END) + 1)::DOUBLE AS s_e, (count(*) + 5)::DOUBLE AS s_b FROM customer GROUP BY ALL
  ) USING (stratum)
)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle for each nation on the lattice, wider and higher by its key."""
    k = F.col("n_nationkey").cast("long")
    n = table(spark, d, "nation")
    x0, y0 = (k % 5).cast("double"), F.expr("cast(n_nationkey as bigint) div 5").cast("double")
    return G.rectangles(n.select(k.alias("id"), F.col("n_regionkey").alias("region"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.5 + (k % 3) * 0.25).alias("x1"), (y0 + 0.5 + (k % 4) * 0.125).alias("y1")))


CELLS = """cells AS (
  SELECT id, region, x0, y0, x0 + 0.5 + (id % 3) * 0.25 AS x1, y0 + 0.5 + (id % 4) * 0.125 AS y1 FROM (
    SELECT n_nationkey::BIGINT AS id, n_regionkey AS region, (n_nationkey % 5)::DOUBLE AS x0, (n_nationkey // 5)::DOUBLE AS y0 FROM nation)
), shapes AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) AS a, 2 * (x1 - x0 + y1 - y0) AS p FROM cells)"""


def quarters(spark: SparkSession, d: str) -> DataFrame:
    """Four large rectangles that cover the lattice."""
    r = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("long").alias("id"))
    x0, y0 = (F.col("id") % 2) * 2.6, F.expr("id div 2") * 2.4
    return G.rectangles(r.select("id", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 2.6).cast("double").alias("x1"), (y0 + 2.6).cast("double").alias("y1")))


QUARTERS = """quarters AS (
  SELECT id, x0, y0, x0 + 2.6::DOUBLE AS x1, y0 + 2.6::DOUBLE AS y1 FROM (
    SELECT r_regionkey::BIGINT AS id, (r_regionkey % 2) * 2.6::DOUBLE AS x0, (r_regionkey // 2) * 2.4::DOUBLE AS y0 FROM region WHERE r_regionkey < 4)
)"""


def lattice(nodes: DataFrame, width: int, rook: bool = True) -> DataFrame:
    return W.lattice(nodes, width, rook)


def lattice_sql(width: int, rook: bool = True) -> str:
    steps = "(0,-1),(0,1),(-1,0),(1,0)" + ("" if rook else ",(-1,-1),(-1,1),(1,-1),(1,1)")
    return f"""edges AS (
  SELECT a.id AS focal, b.id AS neighbor, 1.0::DOUBLE AS weight
  FROM nodes a CROSS JOIN (VALUES {steps}) o(dy, dx) JOIN nodes b ON b.id = a.id + dy * {width} + dx
  WHERE a.id % {width} + dx BETWEEN 0 AND {width - 1}
)"""


def band_sql(r: float) -> str:
    return f"""edges AS (
  SELECT a.id AS focal, b.id AS neighbor, 1.0::DOUBLE AS weight, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d
  FROM nodes a JOIN nodes b ON a.id <> b.id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= {r}
)"""


ROW = "w AS (SELECT focal, neighbor, weight / sum(weight) OVER (PARTITION BY focal) AS weight FROM edges)"
BIN = "w AS (SELECT focal, neighbor, 1.0::DOUBLE AS weight FROM edges)"
SUMMARY = """summary AS (
  SELECT (SELECT sum(weight) FROM w) AS s0,
         (SELECT sum(weight * weight) FROM w) + (SELECT coalesce(sum(a.weight * b.weight), 0) FROM w a JOIN w b ON a.focal = b.neighbor AND a.neighbor = b.focal) AS s1,
         (SELECT sum(t * t) FROM (SELECT sum(weight) AS t FROM (SELECT focal AS id, weight FROM w UNION ALL SELECT neighbor, weight FROM w) GROUP BY id)) AS s2
)"""


def sf(z: str) -> str:
    """SQL of the upper normal tail, by the same approximation as the columns."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    tail = f"({poly} * exp(-({z}) * ({z}) / 2) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"
