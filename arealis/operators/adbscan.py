"""Approximate DBSCAN by an ensemble of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planar import nearest_one
from .blocks import settle
from .inference import rank_text


def _within(a: np.ndarray, b: np.ndarray, eps: float, tile: int = 65_536) -> Iterator[tuple[slice, np.ndarray]]:
    """Which of b are within eps of each of a, some of b at a time."""
    for k in range(0, len(b), tile):
        yield slice(k, k + tile), ((b[None, k : k + tile] - a[:, None]) ** 2).sum(2) <= eps * eps


def _touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether any of a is within eps of any of b."""
    for one, other in ((0, 1), (1, 0)):  # only what can reach the other's box
        pair = [a, b]
        lo, hi = pair[other].min(0), pair[other].max(0)
        gap = np.maximum(0, np.maximum(lo - pair[one], pair[one] - hi))
        pair[one] = pair[one][(gap * gap).sum(1) <= eps * eps * (1 + 1e-9)]
        a, b = pair
        if not len(pair[one]):
            return False
    return any(hit.any() for k in range(0, len(a), 64) for _, hit in _within(a[k : k + 64], b, eps, 1024))


def dbscan(xy: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels from 0 in order of first core point, -1 for noise; a point counts itself, and
    what several clusters reach is the first one's. Points of a cell are all within eps of
    each other, so full cells need no distances, and cells are joined, not points."""
    label = np.full(len(xy), -1)
    if not len(xy):
        return label
    cell, of = np.unique(np.floor(xy / (eps / 2**0.5 * (1 - 1e-9))).astype(np.int64), axis=0, return_inverse=True)
    order = np.argsort(of.reshape(-1), kind="stable")
    members = np.split(order, np.cumsum(np.bincount(of.reshape(-1)))[:-1])
    at = {c: k for k, c in enumerate(map(tuple, cell.tolist()))}
    steps = sorted(((a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)), key=lambda s: s[0] ** 2 + s[1] ** 2)
    near = lambda k: [at[c] for a, b in steps if (c := (cell[k, 0] + a, cell[k, 1] + b)) in at]
    core = np.zeros(len(xy), bool)
    for k, m in enumerate(members):
        if len(m) >= min_samples:
            core[m] = True
            continue
        count = np.full(len(m), len(m))
        for n in near(k):
            for _, hit in _within(xy[m], xy[members[n]], eps):
                count += hit.sum(1)
        core[m] = count >= min_samples
    cores = [m[core[m]] for m in members]
    root = list(range(len(members)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for step in steps:
        for k, (a, b) in enumerate(cell.tolist()):
            n = at.get((a + step[0], b + step[1]), -1)
            if n > k and len(cores[k]) and len(cores[n]) and find(k) != find(n) and _touch(xy[cores[k]], xy[cores[n]], eps):
                root[find(n)] = find(k)
    roots = np.array([find(k) for k in range(len(members))])[of.reshape(-1)]
    places = np.flatnonzero(core)
    firsts, number = np.unique(roots[places], return_index=True)
    label[places] = np.argsort(np.argsort(number))[np.searchsorted(firsts, roots[places])]
    for k, m in enumerate(members):
        rest = m[~core[m]]
        if not len(rest):
            continue
        best = np.full(len(rest), len(xy))
        for n in [k, *near(k)]:
            for part, hit in _within(xy[rest], xy[cores[n]], eps):
                best = np.minimum(best, np.where(hit, label[cores[n][part]][None, :], len(xy)).min(1, initial=len(xy)))
        label[rest] = np.where(best < len(xy), best, -1)
    return label


def replicate_labels(points: DataFrame, eps: float, min_samples: int, pct_exact: float = 0.1, reps: int = 100, seed: int = 42) -> DataFrame:
    """(rep, id, x, y, label): in each replicate a sample of points (by hash rank) is
    clustered and every point takes the label of its nearest sampled one. A replicate is
    one task, which holds each point once."""
    spark = points.sparkSession
    base = points.select("id", "x", "y")
    n = base.agg(F.count("*").alias("n"))
    order = Window.partitionBy("rep").orderBy(rank_text(seed, F.col("rep"), F.col("id")), "id")
    reps_df = spark.range(reps).select(F.col("id").alias("rep"))
    ranked = base.crossJoin(F.broadcast(reps_df)).withColumn("k", F.row_number().over(order)).crossJoin(F.broadcast(n))
    dealt = ranked.select("rep", "id", "x", "y", (F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * pct_exact))).alias("sampled"))
    least = max(1, int(min_samples * pct_exact))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        xy, own = pdf[["x", "y"]].to_numpy(float), pdf["sampled"].to_numpy(bool)
        known = ~np.isnan(xy).any(1)
        label = np.full(len(pdf), -1)
        s, rest = np.flatnonzero(own & known), np.flatnonzero(~own & known)
        label[s] = dbscan(xy[s], eps, least)
        if len(s):
            label[rest] = label[s][nearest_one(*xy[rest].T, *xy[s].T)]
        return pdf.assign(label=label)[["rep", "id", "x", "y", "label"]]

    return settle(dealt.groupBy("rep").applyInPandas(cluster, "rep long, id long, x double, y double, label int"))


def remap_labels(solutions: DataFrame) -> DataFrame:
    """(rep, id, label): labels of every replicate renamed to those of the replicate with
    most labels (the first of them) whose centroid is nearest; noise stays."""
    c = solutions.where("label <> -1").groupBy("rep", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    most = solutions.groupBy("rep").agg(F.countDistinct("label").alias("k")).agg(F.max_by("rep", F.struct("k", -F.col("rep"))).alias("ref"))
    ref = c.join(F.broadcast(most), F.col("rep") == F.col("ref")).select(F.col("label").alias("to"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    d = F.pow(F.col("cx") - F.col("rx"), 2) + F.pow(F.col("cy") - F.col("ry"), 2)
    cross = c.crossJoin(ref).groupBy("rep", "label").agg(F.min_by("to", F.struct(d.alias("d"), "to")).alias("to"))
    return solutions.join(cross, ["rep", "label"], "left").select("rep", "id", F.coalesce("to", F.lit(-1)).alias("label"))


def ensemble(remapped: DataFrame) -> DataFrame:
    """(id, lbls, pct): the plurality label and its share; ties go to the label that came
    first by replicate."""
    votes = remapped.groupBy("id", "label").agg(F.count("*").alias("k"), F.min("rep").alias("first"))
    total = votes.groupBy("id").agg(F.sum("k").alias("n"), F.max_by(F.struct("label", "k"), F.struct("k", -F.col("first"))).alias("m"))
    return total.select("id", F.col("m.label").alias("lbls"), (F.col("m.k") / F.col("n")).alias("pct"))


def adbscan(points: DataFrame, eps: float, min_samples: int, pct_exact: float = 0.1, reps: int = 100, pct_thr: float = 0.9, seed: int = 42) -> DataFrame:
    """(id, label, lbls, pct): the ensemble's label as text, "-1" where its share is below
    ``pct_thr``."""
    v = ensemble(remap_labels(replicate_labels(points, eps, min_samples, pct_exact, reps, seed)))
    return v.select("id", F.when(F.col("pct") < pct_thr, "-1").otherwise(F.col("lbls").cast("string")).alias("label"), "lbls", "pct")


def _rim(xy: np.ndarray, radius: float, block: int = 8192) -> np.ndarray:
    """Points that a disc of ``radius`` without other points may touch, and perhaps more: a
    point at distance d keeps such discs out of an arc of directions. Where the arcs of a
    few points in the cells around cover the circle, there is no such disc."""
    grid = np.floor(xy / (radius / 8)).astype(np.int64)
    grid -= grid.min(0) - 2
    wide = int(grid[:, 1].max()) + 3
    cells, first = np.unique(grid[:, 0] * wide + grid[:, 1], return_index=True)
    steps = np.array([a * wide + b for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)])
    open_ = np.ones(len(xy), bool)
    for k in range(0, len(xy), block):
        want = (grid[k : k + block, 0] * wide + grid[k : k + block, 1])[:, None] + steps
        at = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
        dx, dy = np.moveaxis(xy[first[at]] - xy[k : k + block, None], 2, 0)
        d = np.where(cells[at] == want, np.hypot(dx, dy), 0)
        part = np.divide(d, 2 * radius, out=np.ones_like(d), where=d > 0) + np.divide(1e-9, d, out=np.zeros_like(d), where=d > 0)
        half, angle = np.arccos(np.minimum(part, 1)), np.arctan2(dy, dx)
        free = np.zeros(len(d), bool)
        for s in range(len(steps)):
            off = np.abs((angle[:, s : s + 1] + half[:, s : s + 1] - angle + np.pi) % (2 * np.pi) - np.pi)
            free |= (half[:, s] > 0) & ~(off < half - 1e-9).any(1)
        open_[k : k + block] = free | ~(half > 0).any(1)
    return open_


def alpha_edges(xy: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Edges (i, j) with an empty circle of ``radius`` through both ends on one side and
    not on the other: the alpha shape's boundary, by checking pairs closer than a diameter.
    Only points on the rim have such edges. What a circle through i holds is within a
    diameter of i, so only the cells around it are looked at, the nearest points first."""
    rim = _rim(xy, radius) if len(xy) else np.zeros(0, bool)
    grid = np.floor(xy / (2 * radius)).astype(np.int64)
    cell, of = np.unique(grid, axis=0, return_inverse=True)
    order = np.argsort(of.reshape(-1), kind="stable")
    cells = dict(zip(map(tuple, cell.tolist()), np.split(order, np.cumsum(np.bincount(of.reshape(-1)))[:-1]), strict=True)) if len(xy) else {}

    def empty(centres, ends, others):
        alive = np.arange(len(centres))
        for a, b in zip([0, *range(64, len(others), 512)], [*range(64, len(others), 512), len(others)], strict=True):
            if not len(alive):
                break
            c, o = centres[alive], others[a:b]
            inside = (np.hypot(*(xy[o][None, :, :] - c[:, None, :]).transpose(2, 0, 1)) < radius - 1e-12) & (o[None, :] != ends[alive][:, None])
            alive = alive[~inside.any(1)]
        out = np.zeros(len(centres), bool)
        out[alive] = True
        return out

    out = []
    for i in np.flatnonzero(rim).tolist():
        a, b = grid[i].tolist()
        near = np.concatenate([cells[c] for da in (-1, 0, 1) for db in (-1, 0, 1) if (c := (a + da, b + db)) in cells])
        near = near[near != i]
        size = np.hypot(*(xy[near] - xy[i]).T)
        near, size = near[size <= 2 * radius], size[size <= 2 * radius]
        if len(near) > 64:
            near, size = near[order := np.argpartition(size, 63)], size[order]
        later = (size > 0) & (near > i) & rim[near]
        ends, length = near[later], size[later]
        d = xy[ends] - xy[i]
        mid = (xy[i] + xy[ends]) / 2
        up = np.stack([-d[:, 1], d[:, 0]], axis=1) / length[:, None] * np.sqrt(np.maximum(radius * radius - length * length / 4, 0))[:, None]
        one, two = empty(mid + up, ends, near), empty(mid - up, ends, near)
        out += [(i, j) for j in sorted(ends[(one != two) | (len(xy) == 2)].tolist())]
    return out


def cluster_boundary(labels: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(label, a, b): boundary edges, as pairs of ids, of the alpha shape of each cluster;
    noise has none."""
    rows = labels.where("label <> '-1'").join(points, "id")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        e = alpha_edges(pdf[["x", "y"]].to_numpy(float), radius)
        return pd.DataFrame([(pdf["label"][0], pdf["id"][i], pdf["id"][j]) for i, j in e], columns=["label", "a", "b"])

    return rows.select("label", "id", "x", "y").groupBy("label").applyInPandas(solve, "label string, a long, b long")
