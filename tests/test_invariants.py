"""Properties that hold whatever the data, and the agreement of queries with their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from arealis.functions.columns import p_of_array
from arealis.operators import inference, local_stats, weights
from arealis.plans.queries import QUERIES, SQL
from arealis.sources import read_gal, read_geojson
from arealis.sources.files import dense_positions

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["moran_permutation", "moran_local_permutation", "geary", "join_counts_local", "rate_spatial_empirical_bayes", "correlogram_band", "completeness", "weights_knn"])
def test_queries_agree_with_sql(spark, duck, name):
    a, b = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.sql(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    norm = lambda d: sorted(tuple(round(float(v), 6) if not isinstance(v, str) else v for v in r) for r in d[cols].fillna(-9).itertuples(index=False))
    for x, y in zip(norm(a), norm(b), strict=True):
        assert x == pytest.approx(y, abs=2e-6) if not any(isinstance(v, str) for v in x) else [v for v in x if isinstance(v, str)] == [v for v in y if isinstance(v, str)]


def test_pseudo_p_values(spark):
    d = spark.createDataFrame([(0.5, [0.1, 0.2, 0.5, 0.9, 0.7, 0.3, 0.4, 0.6, 0.8]), (2.0, [0.1] * 9)], "obs double, sims array<double>")
    p = {k: p_of_array(F.col("obs"), F.col("sims"), k).alias(k.replace("-", "_")) for k in ("directed", "greater", "lesser", "folded", "two-sided")}
    a, b = d.select(*p.values()).collect()
    assert a.greater + a.lesser == pytest.approx(1 + 2 / 10) and a.directed <= a.two_sided <= 1
    assert b.greater == pytest.approx(0.1) and b.lesser == 1.0 and b.folded == pytest.approx(0.1)
    with pytest.raises(ValueError):
        p_of_array(F.col("obs"), F.col("sims"), "other")


def test_conditional_draws_leave_the_site_out(spark):
    n = spark.range(6).select("id", F.col("id").alias("pos"), F.pow(F.lit(10.0), F.col("id")).alias("v"))
    w = weights.lattice(n, 3)
    sims = inference.conditional(n, w, ["v"], lambda o, v, x: v("v"), lambda o, t: t, reps=50).collect()
    assert len(sims) == 300
    for r in sims:
        digits = f"{int(r.sim):06d}"[::-1]
        assert digits[r.id] == "0" and set(digits) <= {"0", "1"}


def test_transforms(spark):
    n = spark.range(9).select("id")
    w = weights.lattice(n, 3, rook=False)
    rows = {r.focal: r.s for r in weights.transform(w, "r").groupBy("focal").agg(F.sum("weight").alias("s")).collect()}
    assert all(v == pytest.approx(1) for v in rows.values()) and len(rows) == 9
    assert weights.transform(w, "d").agg(F.sum("weight")).first()[0] == pytest.approx(1)
    assert weights.transform(w, "v").agg(F.sum("weight")).first()[0] == pytest.approx(9)
    s = weights.summary(w).first()
    assert (s.s0, s.s1, s.n_edges) == (40, 80, 40)
    with pytest.raises(ValueError):
        weights.transform(w, "q")
    assert weights.subset(w, n.where("id < 3")).count() == 4


def test_islands_keep_a_row(spark):
    n = spark.createDataFrame([(i, i, float(i)) for i in range(4)], "id long, pos long, y double")
    w = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "focal long, neighbor long, weight double")
    assert local_stats.moran_local(n, w, reps=9).count() == 4
    assert local_stats.geary_local(n, w).where("id = 3").first().c == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.gal").write_text("3\n1 2\n2 3\n2 1\n1\n3 1\n1\n")
    assert sorted((r.focal, r.neighbor) for r in read_gal(spark, str(tmp_path / "a.gal")).collect()) == [("1", "2"), ("1", "3"), ("2", "1"), ("3", "1")]
    (tmp_path / "b.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"v":3},"geometry":{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1],[0,0]],[[0.1,0.1],[0.2,0.2],[0.1,0.2]]]}},{"type":"Feature","properties":{"v":4},"geometry":{"type":"Point","coordinates":[2,3]}}]}')
    a, b = read_geojson(spark, str(tmp_path / "b.json"), "v int").orderBy("id").collect()
    assert a.v == 3 and len(a.geom[0].shell) == 4 and len(a.geom[0].holes) == 1 and (b.x, b.y, b.geom) == (2.0, 3.0, None)


def test_dense_positions(spark):
    d = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "id long")
    assert [(r.id, r.pos) for r in dense_positions(d).orderBy("id").collect()] == [(i, i) for i in range(101)]
