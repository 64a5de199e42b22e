"""What the operators of this folder share: shared-folder tables, graph components, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A temporary folder is set only where the setting is missing, as in local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:  # the setting itself cannot be changed in a running session
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    so a lost executor costs one stage and never a rerun of the whole plan."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned and that nothing reads any more."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, run, schema: str, key: str = "doc_id") -> DataFrame:
    """``mapInPandas`` in which the id travels as text: pandas would turn whole numbers
    that have a null beside them into floats, which keep 53 bits of an id."""
    out = df.withColumn(key, F.col(key).cast("string")).mapInPandas(run, schema.replace(f"{key} long", f"{key} string", 1))
    return out.withColumn(key, F.col(key).cast("long"))


def free(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps: their frames must be unreachable.

    Spark's cleaner works in the background, on what a collection has found; without the
    second one and the pauses the files are still there while the next step writes its own.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(id, component)``.

    Distributed union-find by label propagation: every node starts with the smallest id
    among its neighbours and itself. In a round, nodes whose label has changed tell their
    neighbours, and nodes whose label is no root any more take their label's own label, so
    long chains shrink by half a round; what has settled makes no rows. Labels are merged
    by a grouped minimum, which combines before the shuffle, so a hub with a third of all
    edges is no single task's work. Only ids that have an edge appear. Raises RuntimeError
    if ``max_rounds`` do not suffice, so that a partial answer is never returned.
    """
    both = edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"))])).alias("e")).select("e.a", "e.b")
    both = cut(both.distinct(), "edges")
    new = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component"), F.col("id").alias("before")), "labels")
    for _ in range(max_rounds):
        moved = new.where("component < before").select("id", "component")
        if not moved.limit(1).count():
            discard(both)
            return new.select("id", "component")
        told = both.join(moved, both.b == moved.id).select(F.col("a").alias("id"), "component")
        far = new.where("component < id").select(F.col("id").alias("component"), F.col("component").alias("far"))
        jumped = new.select("id", "component").join(far, "component").select("id", F.col("far").alias("component"))
        none = F.lit(None).cast("long").alias("before")
        merged = new.select("id", "component", F.col("component").alias("before")).unionByName(told.unionByName(jumped).select("id", "component", none))
        old, new = new, cut(merged.groupBy("id").agg(F.min("component").alias("component"), F.max("before").alias("before")), "labels")
        discard(old)
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def link_buckets(members: DataFrame, verify, small: int = 32, factor: int = 8, settle=None) -> DataFrame | None:
    """Components of the links between members of each bucket; no component is lost.

    ``members(bucket, id, size, first)`` has the members of buckets of two and more, with
    the bucket's size and smallest id; ``verify(pairs(a, b))`` returns the pairs that are
    links. Returns a table (id, component) of linked ids, or None if there are no links.

    Not all pairs of a bucket are made. A bucket of at most ``small`` members is compared
    whole. In a larger one all members meet a few pivots: its first member, then about
    ``factor`` members picked by hash, then ``factor`` times as many, and so on to all. What is in
    one component already meets no more, and a bucket whose members are all in one
    component is done. So a group of near copies ends after a round or two, at a cost in
    proportion to its size, and yet every two members of a bucket have met or are
    connected when the rounds end. Pivots are picked without sorting a bucket, and the
    join of members and pivots can be split where a bucket is hot.
    """
    spark, links, labels, pivots = members.sparkSession, None, None, 1
    while True:
        if links is None:
            here = members.withColumn("label", F.col("id"))
        else:
            here = members.where(F.col("size") > small)
            if labels is not None:
                here = here.join(labels, "id", "left")
            here = here.select("bucket", "id", "size", "first", (F.coalesce("component", "id") if labels is not None else F.col("id")).alias("label"))
            open_ = here.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
            here = cut(here.join(open_, "bucket"), "open")
            largest = here.agg(F.max("size")).first()[0]
            if largest is None or pivots // factor >= largest:  # all members were pivots before
                return labels
            if settle is not None:
                return components(links.unionByName(cut(settle(here).select("a", "b"), "links")))
        # The hash is of the id alone, so that a group's buckets agree on their pivots.
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("size")
        here = here.withColumn("pivot", (F.col("size") <= small) | (F.col("id") == F.col("first")) | (share < F.lit(pivots << 30)) & F.lit(pivots > 1))
        once = ~F.col("m.pivot") | (F.col("m.id") < F.col("p.id"))  # two pivots meet once
        pairs = here.alias("m").join(here.where("pivot").alias("p"), (F.col("m.bucket") == F.col("p.bucket")) & (F.col("m.label") != F.col("p.label")) & once)
        pairs = cut(pairs.select(F.least("m.id", "p.id").alias("a"), F.greatest("m.id", "p.id").alias("b")).distinct(), "pairs")
        found = cut(verify(pairs).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        if found.limit(1).count():
            labels = components(links)
        pivots *= factor
        free(spark)
