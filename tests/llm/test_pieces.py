import math
from collections import Counter

import numpy as np
import pytest

from arealis.llm.pieces import Vocabulary, decode, encode_sampled, load_pieces, sample_block

from .conftest import edge_rows


@pytest.fixture(scope="module")
def v():
    return Vocabulary(*load_pieces())


def all_segmentations(text, v):
    by = {bytes(v.spelling[a : a + n]).decode(): i for i, (a, n) in enumerate(zip(v.begin, v.size, strict=True)) if i > 258}
    weight = dict(zip(v.ids.tolist(), v.weights.tolist(), strict=True))
    out, s = {}, " " + text

    def walk(p, ids, w):
        if p == len(s):
            out[tuple(ids)] = w
        for e in range(p + 1, len(s) + 1):
            if s[p:e] in by and " " not in s[p + 1 : e]:
                walk(e, [*ids, by[s[p:e]]], w + weight[by[s[p:e]]])

    walk(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: w - z for k, w in out.items()}


def test_distribution_and_inclusion(v):
    want = all_segmentations("the cat", v)
    n, first, total = 2000, Counter(), 0.0
    for samples in sample_block(list(range(n)), ["the cat"] * n, 3, v):
        assert len({tuple(x[3].tolist()) for x in samples}) == 3
        assert samples[0][1] >= samples[1][1] >= samples[2][1]
        first[tuple(samples[0][3].tolist())] += 1
        for p, _, q, ids in samples:
            assert math.isclose(p, want[tuple(ids.tolist())], abs_tol=1e-4)
            total += math.exp(p) / q
    assert abs(total / n - 1) < 0.02  # inverse inclusion weights estimate the whole
    for k, p in want.items():
        assert abs(first[k] / n - math.exp(p)) < 0.04


def test_all_of_few(v):
    want = all_segmentations("a", v)
    [samples] = sample_block([1], ["a"], 5, v)
    assert {tuple(x[3].tolist()) for x in samples} == set(want) and all(x[2] == 1.0 for x in samples)


@pytest.mark.parametrize("text", ["x\n\ny  z▁q \t\U0001f600 é漢", "a" * 3000, " ", "\x00\ud800", "<0x41> </s> <unk>"])
def test_round_trip(v, text):
    [samples] = sample_block([3], [text], 3, v)
    assert all(decode(x[3], v) == text for x in samples) and len({tuple(x[3].tolist()) for x in samples}) == len(samples)


def test_draws_do_not_depend_on_the_block(v):
    texts = ["one two three", "hello world again", "so it goes"]
    together = sample_block([1, 2, 3], texts, 3, v)
    for i, t in enumerate(texts):
        [alone] = sample_block([i + 1], [t], 3, v)
        assert [x[3].tolist() for x in alone] == [x[3].tolist() for x in together[i]]


def test_rows(docs, empty):
    got = encode_sampled(docs, k=2).collect()
    assert all(r.round_trip for r in got)
    per = Counter((r.doc_id, r["sample"]) for r in got)
    texts = {r[0]: r[1] for r in edge_rows()}
    for doc, text in texts.items():
        assert per[doc, 1] >= 1 and (per[doc, 2] == 0 or text)
    assert encode_sampled(empty).count() == 0
    ids = encode_sampled(docs.where("doc_id = 10"), k=2, digest=False).collect()
    assert all(len(r.ids) == r.n_tokens for r in ids)
