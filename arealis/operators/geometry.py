"""Polygon shape measures over (id, geom), geom an array of parts with a shell and holes,
rings of struct<x, y>, closed or not.

Areas, lengths and moments are folds over ring arrays; what needs a hull, a smallest
rectangle or a smallest circle goes through one Arrow UDF that returns those together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio

GEOM = "array<struct<shell:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _sides(ring: Column) -> Column:
    """Array of (x1, y1, x2, y2) around a ring; a repeated first point adds a side of length 0."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i)["x"].alias("x1"), F.get(ring, i)["y"].alias("y1"), F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2")))


def _cross(s: Column) -> Column:
    return s["x1"] * s["y2"] - s["x2"] * s["y1"]


def _rings(geom: Column) -> Column:
    """All rings with +1 for shells and -1 for holes."""
    return F.flatten(F.transform(geom, lambda p: F.concat(F.array(F.struct(p["shell"].alias("r"), F.lit(1.0).alias("s"))), F.transform(p["holes"], lambda h: F.struct(h.alias("r"), F.lit(-1.0).alias("s"))))))


def _ring_area(ring: Column) -> Column:
    return _sum(F.transform(_sides(ring), _cross)) / 2


def area(geom: Column) -> Column:
    return _sum(F.transform(_rings(geom), lambda x: x["s"] * F.abs(_ring_area(x["r"]))))


def perimeter(geom: Column) -> Column:
    """Length of all rings, holes included."""
    length = lambda s: F.sqrt(F.pow(s["x1"] - s["x2"], 2) + F.pow(s["y1"] - s["y2"], 2))
    return _sum(F.transform(_rings(geom), lambda x: _sum(F.transform(_sides(x["r"]), length))))


def _moments(geom: Column) -> Column:
    """struct(a, mx, my, ixx, iyy) about the origin, holes subtracted, whatever the rings'
    orientation."""

    def one(x):
        sign = x["s"] * F.signum(_ring_area(x["r"]))
        f = lambda g: sign * _sum(F.transform(_sides(x["r"]), g))
        return F.struct(
            (f(_cross) / 2).alias("a"),
            (f(lambda s: (s["x1"] + s["x2"]) * _cross(s)) / 6).alias("mx"),
            (f(lambda s: (s["y1"] + s["y2"]) * _cross(s)) / 6).alias("my"),
            (f(lambda s: (s["y1"] * s["y1"] + s["y1"] * s["y2"] + s["y2"] * s["y2"]) * _cross(s)) / 12).alias("ixx"),
            (f(lambda s: (s["x1"] * s["x1"] + s["x1"] * s["x2"] + s["x2"] * s["x2"]) * _cross(s)) / 12).alias("iyy"),
        )

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "mx", "my", "ixx", "iyy")])
    return F.aggregate(F.transform(_rings(geom), one), zero, lambda t, v: F.struct(*[(t[k] + v[k]).alias(k) for k in ("a", "mx", "my", "ixx", "iyy")]))


def with_moments(polygons: DataFrame) -> DataFrame:
    """Add a, cx, cy and j, the second moment of area about the centroid."""
    d = polygons.withColumn("__m", _moments(F.col("geom")))
    d = d.withColumns({"a": F.col("__m.a"), "cx": ratio("__m.mx", "__m.a"), "cy": ratio("__m.my", "__m.a")})
    return d.withColumn("j", F.col("__m.ixx") + F.col("__m.iyy") - F.col("a") * (F.pow("cx", 2) + F.pow("cy", 2))).drop("__m")


def moment_of_inertia(polygons: DataFrame, normalize: bool = False, ref_pt: tuple[float, float] | None = None) -> DataFrame:
    """(id, j): about the centroid or a point; normalised, a^2 / (2 pi j)."""
    d = with_moments(polygons)
    j = F.col("j") if ref_pt is None else F.col("j") + F.col("a") * (F.pow(F.col("cx") - ref_pt[0], 2) + F.pow(F.col("cy") - ref_pt[1], 2))
    return d.select("id", (ratio(F.pow("a", 2), 2 * math.pi * j) if normalize else j).alias("j"))


def moment_of_inertia_regions(polygons: DataFrame, region: str, weight: str | None = None, normalize: bool = False, ref_pts: DataFrame | None = None) -> DataFrame:
    """(region, j): polygons of a region taken together, about its centroid or its point in
    ``ref_pts(region, px, py)``; with ``weight`` as masses spread evenly over each polygon.
    A region without a point in ``ref_pts`` gets null."""
    d = with_moments(polygons.withColumn("__w", F.col(weight).cast("double") if weight else F.lit(None).cast("double")))
    d = d.withColumn("m", F.coalesce("__w", "a")).withColumn("jm", F.col("m") * ratio("j", "a"))
    c = d.groupBy(region).agg(ratio(F.sum(F.col("m") * F.col("cx")), F.sum("m")).alias("px"), ratio(F.sum(F.col("m") * F.col("cy")), F.sum("m")).alias("py"))
    if ref_pts is not None:
        c = c.select(region).join(ref_pts.select(region, "px", "py"), region, "left")
    x = d.join(c, region)
    g = x.groupBy(region).agg(F.sum(F.col("jm") + F.col("m") * (F.pow(F.col("cx") - F.col("px"), 2) + F.pow(F.col("cy") - F.col("py"), 2))).alias("j"), F.sum("m").alias("m"), F.sum("a").alias("area"))
    return g.select(region, (ratio(F.col("m") * F.col("area"), 2 * math.pi * F.col("j")) if normalize else F.col("j")).alias("j"))


def moment_of_inertia_global(polygons: DataFrame, normalize: bool = False, ref_pt: tuple[float, float] | None = None) -> DataFrame:
    d = polygons.withColumn("__all", F.lit(0))
    points = None if ref_pt is None else d.sparkSession.range(1).select(F.lit(0).alias("__all"), F.lit(float(ref_pt[0])).alias("px"), F.lit(float(ref_pt[1])).alias("py"))
    return moment_of_inertia_regions(d, "__all", normalize=normalize, ref_pts=points).select("j")


def angles(polygons: DataFrame) -> DataFrame:
    """(id, ring, angle): the signed turn at each vertex, ring by ring, shells clockwise."""
    rings = polygons.select("id", F.posexplode(_rings(F.col("geom"))).alias("ring", "x"))
    d = rings.select("id", "ring", F.when(F.get(F.col("x.r"), F.size("x.r") - 1) == F.get(F.col("x.r"), F.lit(0)), F.slice("x.r", 1, F.size("x.r") - 1)).otherwise(F.col("x.r")).alias("r"), F.col("x.s").alias("s"))
    d = d.withColumn("r", F.when(_ring_area(F.col("r")) * F.col("s") > 0, F.reverse("r")).otherwise(F.col("r")))
    n = F.size("r")

    def turn(i):
        a, b, c = F.get("r", i), F.get("r", (i + 1) % n), F.get("r", (i + 2) % n)
        ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
        return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)

    return d.select("id", "ring", F.explode(F.transform(F.sequence(F.lit(0), n - 1), turn)).alias("angle"))


def reflexive_angle_ratio(polygons: DataFrame) -> DataFrame:
    return angles(polygons).groupBy("id").agg(F.avg((F.col("angle") < 0).cast("int")).alias("reflexive_angle_ratio"))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull by the monotone chain."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(q):
        out: list = []
        for v in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(v)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def smallest_rectangle(hull: np.ndarray) -> tuple[float, float]:
    """Sides (shorter, longer) of the smallest enclosing rectangle: one side lies on a hull edge."""
    best = (0.0, 0.0, math.inf)
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        e = b - a
        size = math.hypot(*e)
        if size:
            u = e / size
            along, across = hull @ u, hull @ np.array([-u[1], u[0]])
            w, h = np.ptp(along), np.ptp(across)
            if w * h < best[2]:
                best = (w, h, w * h)
    return min(best[:2]), max(best[:2])


def smallest_circle(hull: np.ndarray) -> float:
    """Radius of the smallest enclosing circle, by Welzl's incremental form over the hull."""

    def of2(a, b):
        return (a + b) / 2, math.hypot(*(a - b)) / 2

    def of3(a, b, c):
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if abs(d) < 1e-300:
            return max((of2(a, b), of2(a, c), of2(b, c)), key=lambda x: x[1])
        p, q = b - a, c - a
        u = np.array([q[1] * (p @ p) - p[1] * (q @ q), p[0] * (q @ q) - q[0] * (p @ p)]) / d
        return a + u, math.hypot(*u)

    def inside(c, p):
        return math.hypot(*(p - c[0])) <= c[1] * (1 + 1e-12) + 1e-300

    pts = list(np.random.default_rng(0).permutation(hull))
    circle = (pts[0], 0.0)
    for i, p in enumerate(pts):
        if not inside(circle, p):
            circle = (p, 0.0)
            for j, q in enumerate(pts[:i]):
                if not inside(circle, q):
                    circle = of2(p, q)
                    for r in pts[:j]:
                        if not inside(circle, r):
                            circle = of3(p, q, r)
    return circle[1]


ENCLOSING = T.StructType([T.StructField(k, T.DoubleType()) for k in ("hull_area", "hull_perimeter", "rect_short", "rect_long", "radius")])


@F.pandas_udf(ENCLOSING)
def _enclosing(geoms: pd.Series) -> pd.DataFrame:
    out = []
    for g in geoms:
        pts = np.array([(p["x"], p["y"]) for part in g for p in part["shell"]], dtype=float)
        hull = convex_hull(pts)
        nxt = np.roll(hull, -1, axis=0)
        out.append((abs(float(np.sum(hull[:, 0] * nxt[:, 1] - nxt[:, 0] * hull[:, 1])) / 2), float(np.sum(np.hypot(*(nxt - hull).T))), *smallest_rectangle(hull), smallest_circle(hull)))
    return pd.DataFrame(out, columns=["hull_area", "hull_perimeter", "rect_short", "rect_long", "radius"])


def shape_measures(polygons: DataFrame, height: str | float | None = None) -> DataFrame:
    """(id, ...): every measure of a polygon's shape side by side."""
    x = F.flatten(F.transform("geom", lambda p: F.transform(p["shell"], lambda q: q["x"])))
    y = F.flatten(F.transform("geom", lambda p: F.transform(p["shell"], lambda q: q["y"])))
    d = with_moments(polygons).withColumns({"p": perimeter(F.col("geom")), "w": F.array_max(x) - F.array_min(x), "h": F.array_max(y) - F.array_min(y), "e": _enclosing("geom")})
    a, p, pi = F.col("a"), F.col("p"), math.pi
    rect = F.col("e.rect_short") * F.col("e.rect_long")
    measures = {
        "area": a,
        "perimeter": p,
        "isoperimetric_quotient": ratio(4 * pi * a, p * p),
        "isoareal_quotient": F.sqrt(ratio(4 * pi * a, p * p)),
        "minimum_bounding_circle_ratio": ratio(a, pi * F.pow("e.radius", 2)),
        "radii_ratio": ratio(F.sqrt(a / pi), "e.radius"),
        "shape_index": ratio(F.sqrt(a / pi), "e.radius"),
        "diameter_ratio": ratio("e.rect_short", "e.rect_long"),
        "diameter_ratio_unrotated": ratio(F.least("w", "h"), F.greatest("w", "h")),
        "length_width_diff": F.col("h") - F.col("w"),
        "boundary_amplitude": ratio("e.hull_perimeter", p),
        "convex_hull_ratio": ratio(a, "e.hull_area"),
        "fractal_dimension_hex": ratio(2 * F.log(p / 6), F.log(a / (3 * math.sin(pi / 3)))),
        "fractal_dimension_square": ratio(2 * F.log(p / 4), F.log(a)),
        "fractal_dimension_circle": ratio(2 * F.log(p / (2 * pi)), F.log(a / pi)),
        "squareness": F.pow(ratio(4 * F.sqrt(a), p), 2),
        "rectangularity": ratio(a, rect),
        "equivalent_rectangular_index": F.sqrt(ratio(a, rect)) * ratio(2 * (F.col("e.rect_short") + F.col("e.rect_long")), p),
        "moment_of_inertia": F.col("j"),
        "nmi": ratio(a * a, 2 * pi * F.col("j")),
        "moa_ratio": ratio(0.5 * pi * F.pow(p / (2 * pi), 4), "j"),
    }
    if height is not None:
        hgt = F.col(height) if isinstance(height, str) else F.lit(float(height))
        volume = a * hgt
        measures["form_factor"] = F.when(volume == 0, 0.0).otherwise(ratio(a, F.pow(volume, F.lit(2 / 3))))
    return d.select("id", *[v.alias(k) for k, v in measures.items()])


def rectangles(cells: DataFrame) -> DataFrame:
    """(id, geom) of axis-parallel rectangles (id, x0, y0, x1, y1), clockwise."""
    corner = lambda a, b: F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    shell = F.array(corner("x0", "y0"), corner("x0", "y1"), corner("x1", "y1"), corner("x1", "y0"))
    empty = F.array().cast("array<array<struct<x:double,y:double>>>")
    return cells.withColumn("geom", F.array(F.struct(shell.alias("shell"), empty.alias("holes"))).cast(GEOM))


def clip_area(a: list, b: list) -> float:
    """Area of the intersection of two polygons with holes: the even-odd area over the
    strips between all vertices and crossings, swept along x."""

    def segments(g):
        out = []
        for part in g:
            for ring in [part["shell"], *part["holes"]]:
                pts = [(p["x"], p["y"]) for p in ring]
                out += [(p, q) if p[0] < q[0] else (q, p) for p, q in zip(pts, pts[1:] + pts[:1], strict=True) if p[0] != q[0]]
        return out

    sa, sb = segments(a), segments(b)
    xs = {v[0] for s in sa + sb for v in s}
    for p, q in sa:
        for r, s in sb:
            lo, hi = max(p[0], r[0]), min(q[0], s[0])
            if lo < hi:
                m1, m2 = (q[1] - p[1]) / (q[0] - p[0]), (s[1] - r[1]) / (s[0] - r[0])
                if m1 != m2:
                    x = (r[1] - p[1] + m1 * p[0] - m2 * r[0]) / (m1 - m2)
                    if lo < x < hi:
                        xs.add(x)
    total, cuts = 0.0, sorted(xs)
    for x0, x1 in zip(cuts, cuts[1:], strict=False):
        x = (x0 + x1) / 2

        def spans(segs, x=x):
            ys = sorted(p[1] + (q[1] - p[1]) / (q[0] - p[0]) * (x - p[0]) for p, q in segs if p[0] < x < q[0])
            return list(zip(ys[::2], ys[1::2], strict=False))

        for lo1, hi1 in spans(sa):
            for lo2, hi2 in spans(sb):
                total += max(0.0, min(hi1, hi2) - max(lo1, lo2)) * (x1 - x0)
    return total
