"""File formats that spatial analyses come in, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RING = "array<array<double>>"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; the schema is given, so the file is read once."""
    return spark.read.csv(path, schema=schema, header=True)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON collections as (id, geom, properties...). ``properties`` is a
    schema string. geom is an array of parts, each with a shell and holes; points have x
    and y instead. A file is read whole by one task; many files are read in parallel."""
    feature = f"struct<type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"struct<features: array<{feature}>>").alias("c"))
    rows = raw.select("file", F.posexplode("c.features").alias("pos", "f"))
    g = F.col("f.geometry.coordinates")
    kind = F.col("f.geometry.type")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(g, f"array<{RING}>"))).when(kind == "MultiPolygon", F.from_json(g, f"array<array<{RING}>>"))
    point = F.when(kind == "Point", F.from_json(g, "array<double>"))

    def ring(r):
        return F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    geom = F.transform(polygons, lambda part: F.struct(ring(part[0]).alias("shell"), F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), ring).alias("holes")))
    return rows.select("file", F.col("pos").cast("long").alias("id"), geom.alias("geom"), point[0].alias("x"), point[1].alias("y"), "f.properties.*")


def read_gal(spark: SparkSession, path: str) -> DataFrame:
    """Edges (focal, neighbor, weight) of a GAL file: after the header, lines in pairs,
    ``id k`` and the k neighbours. Ids are kept as strings."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.rtrim("value"), "\r?\n").alias("v"))
    body = lines.select(F.posexplode(F.slice("v", 2, F.size("v"))).alias("pos", "line"))
    pairs = body.groupBy(F.expr("pos div 2").alias("k")).agg(F.min_by("line", "pos").alias("head"), F.max_by("line", "pos").alias("tail"))
    return pairs.select(F.split(F.trim("head"), " +")[0].alias("focal"), F.explode(F.filter(F.split(F.trim("tail"), " +"), lambda x: x != "")).alias("neighbor"), F.lit(1.0).alias("weight"))


def dense_positions(nodes: DataFrame, id: str = "id") -> DataFrame:
    """Add ``pos``, 0-based in the order of ``id``, without sorting in one task: ids are
    range-partitioned, counted per partition, and numbered within."""
    ranged = nodes.repartitionByRange(F.col(id)).sortWithinPartitions(id).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    # Positions inside a partition follow from the ids that Spark gives: partition * 2^33 + row.
    local = ranged.withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    counts = local.groupBy("__part").agg(F.count("*").alias("__n"))
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(base.select("__part", "__base")), "__part").withColumn("pos", F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")
