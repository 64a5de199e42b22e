import corpus_pipeline
from arealis.llm.mixing import mix_sources
from arealis.llm.queries import QUERIES


def test_stages_and_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = start = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == start.columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        docs = after
    rows = corpus_pipeline.run(spark, d).collect()
    assert rows and all(r.round_trip for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "sentencepiece"]


def test_one_query_an_operator():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 11))


def test_samples_say_their_place_in_the_mixture(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60).cache()
    want = {r.doc_id: (r.slot, r.place) for r in mix_sources(docs).collect()}
    got = corpus_pipeline.encoding(spark, docs.repartition(3), d).collect()
    assert {r.doc_id: (r.slot, r.place) for r in got} == want
    assert len(set(want.values())) > 50 and len({r.slot for r in got}) > 1
