import re
from itertools import combinations

import numpy as np

from arealis.llm.neardup import drop_near_duplicates, least_matches, near_duplicates, prune

from .conftest import edge_rows


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def test_against_all_pairs(docs):
    rows = {r[0]: sets(r[1]) for r in edge_rows() if r[0] is not None}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(rows), 2):
        x, y = rows[a], rows[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = near_duplicates(docs).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(rows[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_large_group_of_near_copies_is_settled(spark):
    """A chain: neighbours are linked, far members are not; one component all the same."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 3 * i % 400] and [f"c{k}" if k < 2 * i else w for k, w in enumerate(words)])) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    s = {i: sets(t) for i, t in rows}
    root = {i: i for i, _ in rows}
    for i, j in combinations(range(60), 2):
        if 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
            a, b = root[i], root[j]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {r.doc_id: r.component_id for r in got} == root


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0
    assert drop_near_duplicates(empty).columns == empty.columns


def test_pruning_keeps_similar_and_drops_dissimilar():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (2000, 128), dtype=np.uint8)
    far = np.where(rng.random((2000, 128)) < 0.3, a, rng.integers(0, 256, (2000, 128), dtype=np.uint8))
    close = np.where(rng.random((2000, 128)) < 0.9, a, rng.integers(0, 256, (2000, 128), dtype=np.uint8))
    rows = lambda m: [x.tobytes() for x in m]
    assert prune(rows(a), rows(close), 0.85, 1e-6).all()
    assert not prune(rows(a), rows(far), 0.85, 1e-6).any()
    assert list(least_matches(0.85, 1e-6)) == sorted(least_matches(0.85, 1e-6))
