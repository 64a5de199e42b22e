"""Queries without SQL use every row of their table, also beyond the 500 of the small ones."""

import numpy as np

from arealis.operators.adbscan import alpha_edges
from arealis.plans import domains
from arealis.plans.queries import QUERIES


def test_clusters_and_correlogram_use_all_points(spark):
    d = "/root/testdata/sf0.1"
    n = domains.all_points(spark, d).count()
    assert n == 2000 and QUERIES["adbscan"](spark, d).count() == n
    assert not hasattr(domains, "points")


def test_alpha_edges_against_all_points():
    rng = np.random.default_rng(3)
    xy, r = rng.normal(0, 0.15, (150, 2)), 0.1
    want = []
    for i in range(150):
        for j in range(i + 1, 150):
            d = xy[j] - xy[i]
            s = np.hypot(*d)
            if s <= 2 * r:
                up = np.array([-d[1], d[0]]) / s * np.sqrt(r * r - s * s / 4)
                others = np.delete(xy, [i, j], axis=0)
                a, b = (not (np.hypot(*(others - (xy[i] + xy[j]) / 2 - k * up).T) < r - 1e-12).any() for k in (1, -1))
                want += [(i, j)] * (a != b)
    assert alpha_edges(xy, r) == want and want
