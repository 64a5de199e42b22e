"""Clusters and their outlines against plain definitions, at sizes where lists of neighbours do not fit."""

import tracemalloc

import numpy as np

from arealis.operators.adbscan import _rim, alpha_edges, dbscan
from arealis.plans.queries import QUERIES


def plain(xy, eps, least):
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label, found = np.full(len(xy), -1), 0
    for i in np.flatnonzero(core):
        if label[i] == -1 or not core[i]:
            todo, seen = [i], {i}
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            label[sorted(seen)] = found
            found += 1
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)
    return label


def test_dbscan_against_its_definition():
    rng = np.random.default_rng(4)
    for t in range(40):
        xy = np.concatenate([rng.normal(rng.normal(0, 0.3, 2), 0.06, (60, 2)) for _ in range(3)]).round(2 + t % 4)
        eps, least = rng.choice([0.02, 0.05, 0.08]), int(rng.choice([1, 3, 8]))
        assert dbscan(xy, eps, least).tolist() == plain(xy, eps, least).tolist()


def test_crowded_points_need_little_memory():
    xy = np.random.default_rng(6).normal(0, 0.1, (6000, 2))
    tracemalloc.start()
    label, edges = dbscan(xy, 0.2, 5), alpha_edges(xy, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(label.tolist()) == {0} and edges and peak < 40e6
    rim = _rim(xy, 0.1)
    assert rim.sum() < 300 and all(rim[i] and rim[j] for i, j in edges)


def test_a_replicate_holds_each_point_once(spark):
    p = QUERIES["adbscan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in p
