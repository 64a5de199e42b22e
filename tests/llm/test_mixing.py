from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from arealis.llm.mixing import mix_documents, mix_sources, plan_period, target_units

from .conftest import edge_rows


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=25))
def test_less_than_one_block_from_target(sizes):
    units = target_units({f"s{i}": v for i, v in enumerate(sizes)}, 256)
    plan = plan_period(units)
    assert sum(units.values()) == 256 and sorted(s for v in plan.values() for s in v) == list(range(256))
    for s, slots in plan.items():
        had, own = 0, set(slots)
        for t in range(256):
            had += t in own
            assert abs(had - units[s] * (t + 1) / 256) < 1


def test_rows_are_kept_and_interleaved(spark):
    rows = [(i, "x" * 100, f"s{i % 3 if i % 2 else 0}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, {"s0": 2, "s1": 1, "s2": 1}, period=8, block_chars=1000).orderBy("slot", "place").collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    assert [x for x, _ in Counter(r.slot for r in got).most_common()]
    share = {"s0": 1 / 2, "s1": 1 / 4, "s2": 1 / 4}
    blocks = sorted({(r.slot, r.source, r.block) for r in got})
    full = min(max(s for s, x, _ in blocks if x == k) for k in share)
    for n, (slot, _, _) in enumerate(blocks, 1):
        if slot <= full:
            for k, w in share.items():
                assert abs(sum(x == k for _, x, _ in blocks[:n]) - w * n) < 1.3  # units are 1/8 after one each


def test_edges(docs, empty):
    out = mix_documents(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.select("doc_id", "text").distinct().collect()) == sorted({(r[0] or -1, r[1] or "") for r in edge_rows()})
    assert mix_sources(docs).count() == len(edge_rows())
    assert mix_sources(empty).count() == 0
