import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arealis.llm.suffix import MATCH, anchors, parts_frame, remove_repeats, repeated_starts, suffix_array

from .conftest import edge_rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=120))
def test_suffix_array(values):
    t = np.array([*values, 0], dtype=np.int16)
    order = t.tolist()
    assert suffix_array(t, 258).tolist() == sorted(range(len(order)), key=lambda i: order[i:])


def test_repeated_starts():
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 100, 500).astype(np.uint8))
    parts = [base[a : a + 180] for a in rng.integers(0, 320, 12)] + [b"z" * 250]
    docs, starts = rng.integers(0, 5, 13), np.arange(13) * 1000
    seen = {}
    for p, d, s in zip(parts, docs, starts, strict=True):
        for o in range(len(p) - MATCH + 1):
            seen.setdefault(p[o : o + MATCH], []).append((d, s + o))
    for p, d, s, got in zip(parts, docs, starts, repeated_starts(parts, docs, starts), strict=True):
        assert got.tolist() == [o for o in range(len(p) - MATCH + 1) if (d, s + o) > min(seen[p[o : o + MATCH]])]


def test_every_string_has_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(97, 105, 3000).astype(np.uint8)
    at, _ = anchors(x, np.array([1000, 1050, 3000]))
    for a, b in ((0, 1000), (1050, 3000)):
        own = at[(at >= a) & (at < b)] - a
        assert own[0] <= 76 and np.diff(own).max() <= 77 and own[-1] >= b - a - MATCH


def expected():
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1] or "") for r in edge_rows() if r[0] is not None}):
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - MATCH + 1):
            if raw[s : s + MATCH] in seen:
                gone[s : s + MATCH] = True
            seen.add(raw[s : s + MATCH])
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_against_brute_force(docs):
    want = expected()
    for hot in (40_000, 1):
        got = remove_repeats(docs, hot=hot).collect()
        assert len(got) == len(edge_rows())
        for r in got:
            if r.doc_id is not None:
                assert tuple(r)[1:] == want[r.doc_id]


def test_empty_table(empty):
    assert remove_repeats(empty).count() == 0


def test_hashes_keep_all_bits_beside_cold_parts():
    one, two = 2**62 + 12345, -(2**62) - 54321
    hot = (one, two, 2**60 + 1, 5, None, None)
    for out in ([hot], [hot, (7, None, 2, 0, None, b"x" * 100), (0, None, 2, 3, 9, None)]):
        f = parts_frame(out)
        assert (f["key"][0], f["more"][0], f["doc_id"][0]) == (one, two, 2**60 + 1)
        assert f["stop"].isna().tolist()[:2] == [True] * min(2, len(out)) and f["more"].isna().sum() == len(out) - 1
