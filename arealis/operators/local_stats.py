"""Local spatial autocorrelation: a row a node, with analytic moments, labels and, where
``reps`` is given, conditional randomisation (nodes then need a dense ``pos``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import norm_sf, ratio
from .global_stats import _edges, _one
from .inference import conditional, local_p
from .weights import fill_diagonal, lag, row_sums, standardise, transform

LABELS = {1: "High-High", 2: "Low-High", 3: "Low-Low", 4: "High-Low"}


def quadrant(z: Column, lagged: Column, geoda: bool = False) -> Column:
    """1 HH, 2 LH, 3 LL, 4 HL; with ``geoda`` 1 HH, 2 LL, 3 LH, 4 HL. Zero counts as low."""
    lh, ll = (3, 2) if geoda else (2, 3)
    return F.when((z > 0) & (lagged > 0), 1).when((z <= 0) & (lagged > 0), lh).when((z <= 0) & (lagged <= 0), ll).otherwise(4)


def cluster_label(q: Column, p: Column, crit: float = 0.05, geoda: bool = False) -> Column:
    names = {1: "High-High", 2: "Low-Low", 3: "Low-High", 4: "High-Low"} if geoda else LABELS
    out = F.lit("Insignificant")
    for k, v in names.items():
        out = F.when((p < crit) & (q == k), v).otherwise(out)
    return out


def moran_local(nodes: DataFrame, weights: DataFrame, y: str = "y", kind: str = "r", reps: int = 0, seed: int = 42, geoda_quads: bool = False, alternative: str = "directed", crit: float = 0.05) -> DataFrame:
    """(id, z, lag, i, q, e_i, v_i, e_ic, v_ic) and with reps p_sim, its moments and label.
    e_i and v_i are total, e_ic and v_ic conditional moments."""
    w = transform(weights, kind)
    z = standardise(nodes.withColumn("y", F.col(y)), "y")
    d = lag(row_sums(z, w), w, lag="z_y")
    s = z.agg(F.count("*").cast("double").alias("n"), F.sum(F.pow("z_y", 2)).alias("zz"), F.sum(F.pow("z_y", 4)).alias("z4"))
    d = _one(d, s)
    n, zi, wi, w2 = F.col("n"), F.col("z_y"), F.col("wsum"), F.col("wsum2")
    m2 = F.col("zz") / n
    b2 = ratio(F.col("z4") / n, m2 * m2)
    i = ratio((n - 1) * zi * F.col("lag"), F.col("zz"))
    v = ratio(w2 * (n - b2), n - 1) + ratio((wi * wi - w2) * (2 * b2 - n), (n - 1) * (n - 2)) - F.pow(wi / (n - 1), 2)
    vc = F.pow(ratio(zi, m2), 2) * ratio(n, n - 2) * (w2 - wi * wi / (n - 1)) * (m2 - zi * zi / (n - 1))
    extra = [c for c in ("pos",) if c in nodes.columns]
    out = d.select("id", *extra, zi.alias("z"), "lag", i.alias("i"), quadrant(zi, F.col("lag"), geoda_quads).alias("q"), (-wi / (n - 1)).alias("e_i"), v.alias("v_i"), ratio(-zi * zi * wi, (n - 1) * m2).alias("e_ic"), vc.alias("v_ic"), "n", "zz")
    if reps:
        own_w = w.where("focal = neighbor").groupBy(F.col("focal").alias("id")).agg(F.sum("weight").alias("wii"))
        site = out.join(own_w, "id", "left").withColumn("wii", F.coalesce("wii", F.lit(0.0)))
        sims = conditional(site, w, ["z"], lambda o, v, x: x * v("z"), lambda o, t: o("z") * (t + o("wii") * o("z")) * ratio(o("n") - 1, o("zz")), reps, seed, ["wii", "n", "zz"])
        out = local_p(out, sims, "i", alternative).withColumn("label", cluster_label(F.col("q"), F.col("p_sim"), crit, geoda_quads))
    return out.drop("n", "zz", *extra)


def moran_local_bv(nodes: DataFrame, weights: DataFrame, x: str, y: str, kind: str = "r", reps: int = 0, seed: int = 42, geoda_quads: bool = False) -> DataFrame:
    """(id, zx, lag, i, q): x at a site against the lag of y; neighbours' y is drawn."""
    w = transform(weights, kind)
    z = standardise(nodes.withColumns({"x": F.col(x), "y": F.col(y)}), "x", "y")
    d = _one(lag(z, w, lag="z_y"), z.agg(F.count("*").cast("double").alias("n"), F.sum(F.pow("z_x", 2)).alias("zz")))
    scale = ratio(F.col("n") - 1, "zz")
    out = d.select("id", *[c for c in ("pos",) if c in nodes.columns], F.col("z_x").alias("zx"), F.col("z_y").alias("zy"), "lag", (F.col("z_x") * F.col("lag") * scale).alias("i"), quadrant(F.col("z_x"), F.col("lag"), geoda_quads).alias("q"), scale.alias("scale"))
    if reps:
        own_w = w.where("focal = neighbor").groupBy(F.col("focal").alias("id")).agg(F.sum("weight").alias("wii"))
        site = out.join(own_w, "id", "left").withColumn("wii", F.coalesce("wii", F.lit(0.0)))
        sims = conditional(site, w, ["zy"], lambda o, v, x_: x_ * v("zy"), lambda o, t: o("zx") * (t + o("wii") * o("zy")) * o("scale"), reps, seed, ["zx", "wii", "scale"])
        out = local_p(out, sims, "i")
    return out.drop("scale", "zy", "pos")


def moran_local_rate(nodes: DataFrame, weights: DataFrame, e: str, b: str, adjusted: bool = True, **options) -> DataFrame:
    from .rates import assuncao_rate

    rated = assuncao_rate(nodes, e, b) if adjusted else nodes.withColumn("r", ratio(e, b))
    return moran_local(rated, weights, "r", **options)


def geary_local(nodes: DataFrame, weights: DataFrame, y: str = "y", reps: int = 0, seed: int = 42, sig: float = 0.05) -> DataFrame:
    """(id, c) and with reps p_sim and label: 1 outlier-free high, 2 low, 3 other negative,
    4 not significant. Islands keep a row with 0."""
    w = transform(weights, "r")
    z = standardise(nodes.withColumn("y", F.col(y)), "y")
    sums = _edges(z, w, "z_y").groupBy(F.col("focal").alias("id")).agg(F.sum(F.col("weight") * F.pow(F.col("i_z_y") - F.col("j_z_y"), 2)).alias("c"))
    out = z.select("id", *[c for c in ("pos",) if c in nodes.columns], F.col("z_y").alias("z")).join(sums, "id", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    if reps:
        sims = conditional(out, w, ["z"], lambda o, v, x: x * F.pow(o("z") - v("z"), 2), lambda o, t: t, reps, seed)
        out = _one(local_p(out, sims, "c"), out.agg(F.avg("c").alias("mean_c")))
        low, yes = F.col("c") < F.col("mean_c"), F.col("p_sim") <= sig
        out = out.withColumn("label", F.when(low & (F.col("z") > 0) & yes, 1).when(low & (F.col("z") < 0) & yes, 2).when((F.col("c") > F.col("mean_c")) & yes, 3).otherwise(4)).drop("mean_c")
    return out.drop("pos", "z")


def geary_local_mv(nodes: DataFrame, weights: DataFrame, variables: list[str], reps: int = 0, seed: int = 42) -> DataFrame:
    """(id, c): mean over variables of local Geary; variables are permuted jointly."""
    w = transform(weights, "r")
    z = standardise(nodes, *variables)
    zs = [f"z_{v}" for v in variables]
    square = lambda a, b: sum((F.pow(a(v) - b(v), 2) for v in zs), F.lit(0.0)) / len(zs)
    sums = _edges(z, w, *zs).groupBy(F.col("focal").alias("id")).agg(F.sum(F.col("weight") * square(lambda v: F.col(f"i_{v}"), lambda v: F.col(f"j_{v}"))).alias("c"))
    out = z.select("id", *[c for c in ("pos",) if c in nodes.columns], *zs).join(sums, "id", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    if reps:
        out = local_p(out, conditional(out, w, zs, lambda o, v, x: x * square(o, v), lambda o, t: t, reps, seed), "c")
    return out.drop("pos", *zs)


def star_weights(nodes: DataFrame, weights: DataFrame, kind: str = "r", star: bool | float | None = None) -> tuple[DataFrame, bool]:
    """Transformed weights for local G and whether they are starred. None: starred if any
    self-weight is given. True without self-weights: 1 for binary weights, else the row's
    largest weight. A number fills the diagonal before the transform."""
    if kind.lower() not in ("r", "b"):
        raise ValueError("only row-standardised (r) and binary (b) weights have a local G")
    has = weights.where("focal = neighbor").limit(1).count() > 0
    if star is None:
        star = has
    if star is False:
        return transform(weights.where("focal <> neighbor"), kind), False
    if star is True:
        if has:
            return transform(weights, kind), True
        if kind.lower() == "b":
            return fill_diagonal(transform(weights, "b"), nodes), True
        top = weights.groupBy("focal").agg(F.max("weight").alias("weight"))
        own = nodes.select(F.col("id").alias("focal")).join(top, "focal", "left").select("focal", F.col("focal").alias("neighbor"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
        return transform(weights.unionByName(own), kind), True
    return transform(fill_diagonal(weights, nodes, float(star)), kind), True


def g_local(nodes: DataFrame, weights: DataFrame, y: str = "y", kind: str = "r", star: bool | float | None = False, reps: int = 0, seed: int = 42) -> DataFrame:
    """(id, g, e_g, v_g, z_g, p_norm): Gi, or Gi* with ``star``."""
    w, starred = star_weights(nodes, weights, kind, star)
    d = nodes.withColumn("y", F.col(y).cast("double"))
    s = d.agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y1"), F.sum(F.pow("y", 2)).alias("y2"))
    d = _one(lag(row_sums(d, w), w, lag="y"), s)
    own = 0 if starred else 1
    size = F.col("n") - own
    rest = F.col("y1") - own * F.col("y")
    mean = rest / size
    var = (F.col("y2") - own * F.pow("y", 2)) / size - mean * mean
    wi = F.col("wsum")
    v_g = ratio(wi * (size - wi), (size - 1) * size * size) * ratio(var, mean * mean)
    out = d.select("id", *[c for c in ("pos",) if c in nodes.columns], "y", ratio("lag", rest).alias("g"), (wi / size).alias("e_g"), v_g.alias("v_g"), rest.alias("rest"))
    out = out.withColumn("z_g", ratio(F.col("g") - F.col("e_g"), F.sqrt(F.when(F.col("v_g") > 0, F.col("v_g"))))).withColumn("p_norm", norm_sf(F.abs("z_g")))
    if reps:
        own_w = w.where("focal = neighbor").groupBy(F.col("focal").alias("id")).agg(F.sum("weight").alias("wii"))
        site = out.join(own_w, "id", "left").withColumn("wii", F.coalesce("wii", F.lit(0.0)))
        sims = conditional(site, w, ["y"], lambda o, v, x: x * v("y"), lambda o, t: ratio(t + o("wii") * o("y"), o("rest")), reps, seed, ["wii", "rest"])
        out = local_p(out, sims, "g")
    return out.drop("pos", "y", "rest")


def _join_count(nodes: DataFrame, weights: DataFrame, match: Column, values: list[str], term, finish, reps: int, seed: int) -> DataFrame:
    """A local join count of edges where ``match`` holds over i_ and j_ columns; p-values
    are null where the count is 0."""
    w = transform(weights.where("focal <> neighbor"), "b")
    sums = _edges(nodes, w, *values).groupBy(F.col("focal").alias("id")).agg(F.sum(F.when(match, 1).otherwise(0)).cast("double").alias("ljc"))
    out = nodes.select("id", *[c for c in ("pos",) if c in nodes.columns], *values).join(sums, "id", "left").withColumn("ljc", F.coalesce("ljc", F.lit(0.0)))
    if reps:
        out = local_p(out, conditional(out, w, values, term, finish, reps, seed), "ljc")
        out = out.withColumn("p_sim", F.when(F.col("ljc") != 0, F.col("p_sim")))
    return out.drop("pos", *values)


def join_counts_local(nodes: DataFrame, weights: DataFrame, y: str = "y", reps: int = 0, seed: int = 42) -> DataFrame:
    """(id, ljc): neighbours that are 1 where the site is 1."""
    d = nodes.withColumn("y", (F.col(y) == 1).cast("int"))
    return _join_count(d, weights, (F.col("i_y") == 1) & (F.col("j_y") == 1), ["y"], lambda o, v, x: v("y"), lambda o, t: (o("y") * t).cast("double"), reps, seed)


def join_counts_local_bv(nodes: DataFrame, weights: DataFrame, x: str, z: str, case: str = "CLC", reps: int = 0, seed: int = 42) -> DataFrame:
    """(id, ljc): BJC counts x=1, z=0 here beside x=0, z=1 there; CLC counts co-location of
    both here and there."""
    d = nodes.withColumns({"x": (F.col(x) == 1).cast("int"), "z": (F.col(z) == 1).cast("int")})
    ix, iz, jx, jz = (F.col(c) for c in ("i_x", "i_z", "j_x", "j_z"))
    if case == "BJC":
        return _join_count(d, weights, (ix == 1) & (iz == 0) & (jx == 0) & (jz == 1), ["x", "z"], lambda o, v, w: v("z"), lambda o, t: (o("x") * t).cast("double"), reps, seed)
    if case == "CLC":
        return _join_count(d, weights, (ix == 1) & (iz == 1) & (jx == 1) & (jz == 1), ["x", "z"], lambda o, v, w: v("x") * v("z"), lambda o, t: (o("z") * t).cast("double"), reps, seed)
    raise NotImplementedError(f"case {case!r}: BJC and CLC are known")


def join_counts_local_mv(nodes: DataFrame, weights: DataFrame, variables: list[str], reps: int = 0, seed: int = 42) -> DataFrame:
    """(id, ljc): neighbours where all variables are 1, if all are 1 here."""
    every = F.lit(1)
    for v in variables:
        every = every * (F.col(v) == 1).cast("int")
    return join_counts_local(nodes.withColumn("__all", every), weights, "__all", reps, seed)


def lee_local(nodes: DataFrame, weights: DataFrame, x: str, y: str, reps: int = 0, seed: int = 42) -> DataFrame:
    """(id, l): products of the lags of both variables. Replicates draw the neighbours'
    pairs together."""
    w = transform(weights, "r")
    z = standardise(nodes.withColumns({"x": F.col(x), "y": F.col(y)}), "x", "y")
    out = lag(z, w, lx="z_x", ly="z_y").select("id", *[c for c in ("pos",) if c in nodes.columns], "z_x", "z_y", (F.col("lx") * F.col("ly")).alias("l"))
    if reps:
        one = conditional(out, w, ["z_x"], lambda o, v, t: t * v("z_x"), lambda o, t: t, reps, seed).withColumnRenamed("sim", "sx")
        two = conditional(out, w, ["z_y"], lambda o, v, t: t * v("z_y"), lambda o, t: t, reps, seed).withColumnRenamed("sim", "sy")
        out = local_p(out, one.join(two, ["id", "rep"]).select("id", "rep", (F.col("sx") * F.col("sy")).alias("sim")), "l")
    return out.drop("pos", "z_x", "z_y")


def losh(nodes: DataFrame, weights: DataFrame, y: str = "y", a: float = 2, inference: str | None = None) -> DataFrame:
    """(id, h, e_h, v_h) and with chi-square inference z_h and p: local spatial
    heteroskedasticity. p is only defined for a = 2."""
    from ..functions.numeric import chi2_sf

    if inference not in (None, "chi-square"):
        raise NotImplementedError(f"inference {inference!r}: chi-square is known")
    d = lag(row_sums(nodes.withColumn("y", F.col(y).cast("double")), weights), weights, ly="y")
    d = d.withColumn("e", F.pow(F.abs(F.col("y") - ratio("ly", "wsum")), F.lit(float(a))))
    m = d.agg(F.avg("e").alias("em"), F.avg(F.pow("e", 2)).alias("e2"), F.count("*").cast("double").alias("n"))
    d = _one(lag(d, weights, le="e"), m)
    w1, w2 = F.col("wsum"), F.col("wsum2")
    h = ratio("le", F.col("em") * w1)
    v = ratio(1, F.col("n") - 1) * ratio(F.col("e2") - F.pow("em", 2), F.pow(F.col("em") * w1, 2)) * (F.col("n") * w2 - w1 * w1)
    out = d.select("id", h.alias("h"), F.lit(1.0).alias("e_h"), v.alias("v_h"))
    if inference and a == 2:
        out = out.withColumn("z_h", ratio(2 * F.col("h"), "v_h")).withColumn("p", chi2_sf(F.col("z_h"), ratio(2, "v_h")))
    return out


def cross_plot(nodes: DataFrame, weights: DataFrame, y: str = "y", reps: int = 99, seed: int = 42, sig: float = 0.05, inference: str | None = None) -> DataFrame:
    """LOSH, local Moran and local G of one variable side by side, with the class that the
    plot colours by: which of G and Moran are significant, and whether G is high or low."""
    g = g_local(nodes, weights, y, reps=reps, seed=seed).select("id", F.col("z_g"), F.col("p_sim").alias("p_g"))
    m = moran_local(nodes, weights, y, reps=reps, seed=seed).select("id", F.col("z_sim").alias("z_i"), F.col("p_sim").alias("p_i"))
    h = losh(nodes, weights, y, inference=inference)
    both, hot = g.join(m, "id").join(h, "id"), F.col("z_g") > 0
    sg, si = F.col("p_g") < sig, F.col("p_i") < sig
    kind = F.when(sg & si & hot, "both, high").when(sg & si, "both, low").when(sg & hot, "G only, high").when(sg, "G only, low").when(si, "Moran only").otherwise("neither")
    return both.select("id", "z_g", "z_i", "p_g", "p_i", "h", (F.exp("h") * 10).alias("size"), kind.alias("class"))


def quadrant_mv(x: Column, y: Column) -> Column:
    """1 to 4 by signs: (signs differ) + 2 (y below 0) + 1."""
    return (F.signum(x) != F.signum(y)).cast("int") + 2 * (y < 0).cast("int") + 1


def _inverse(nodes: DataFrame, design: list[str]) -> np.ndarray:
    """(D'D)^-1 from one aggregation: p * p sums reach the driver, whatever the rows."""
    p = len(design)
    row = nodes.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(design) for j, b in enumerate(design) if i <= j]).first()
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
    return np.linalg.inv(m)


def moran_partial(nodes: DataFrame, weights: DataFrame, y: str, covariates: list[str], unit_scale: bool = True, reps: int = 0, seed: int = 42) -> DataFrame:
    """(id, i, q, partial_<x>...): local Moran with covariates held in the design
    [1, z, X]; column z of D (D'D)^-1 (n - 1) times the lag."""
    w = transform(weights, "r")
    names = ["y", *[f"x{k}" for k in range(len(covariates))]]
    d = nodes.withColumns({"y": F.col(y).cast("double"), **{f"x{k}": F.col(c).cast("double") for k, c in enumerate(covariates)}})
    z = standardise(d, *names, scale=unit_scale).withColumn("one", F.lit(1.0))
    design = ["one", *[f"z_{n}" for n in names]]
    inv = _inverse(z, design)
    l = _one(lag(z, w, lag="z_y"), z.agg(F.count("*").cast("double").alias("n")))  # noqa: E741
    part = lambda k, of: sum((of(c) * float(inv[i, k]) for i, c in enumerate(design)), F.lit(0.0))
    scale = F.col("n") - 1
    cols = [(part(k, F.col) * scale * F.col("lag")).alias("i" if k == 1 else f"partial_{covariates[k - 2]}") for k in range(1, len(design))]
    out = l.select("id", *[c for c in ("pos",) if c in nodes.columns], *design, "n", *cols, quadrant_mv(F.col("z_y"), F.col("lag")).alias("q"))
    if reps:
        sims = conditional(out, w, ["z_y"], lambda o, v, t: t * v("z_y"), lambda o, t: part(1, o) * (o("n") - 1) * t, reps, seed, [*design, "n"])
        out = local_p(out, sims, "i", "two-sided")
    return out.drop("pos", "n", *design)


def moran_conditional(nodes: DataFrame, weights: DataFrame, y: str, covariates: list[str], unit_scale: bool = True, reps: int = 0, seed: int = 42) -> DataFrame:
    """(id, i, q): local Moran of the residuals of y regressed on the covariates."""
    w = transform(weights, "r")
    names = ["y", *[f"x{k}" for k in range(len(covariates))]]
    d = nodes.withColumns({"y": F.col(y).cast("double"), **{f"x{k}": F.col(c).cast("double") for k, c in enumerate(covariates)}})
    z = standardise(d, *names, scale=unit_scale).withColumn("one", F.lit(1.0))
    design = ["one", *[f"z_x{k}" for k in range(len(covariates))]]
    inv = _inverse(z, design)
    row = z.agg(*[F.sum(F.col(c) * F.col("z_y")).alias(c) for c in design]).first()
    beta = inv @ np.array([row[c] for c in design])
    r = z.withColumn("r", F.col("z_y") - sum((F.col(c) * float(b) for c, b in zip(design, beta, strict=True)), F.lit(0.0)))
    d2 = _one(lag(r, w, lag="r"), r.agg(F.count("*").cast("double").alias("n"), F.sum(F.pow("r", 2)).alias("rr")))
    scale = ratio(F.col("n") - 1, "rr")
    out = d2.select("id", *[c for c in ("pos",) if c in nodes.columns], "r", (F.col("r") * F.col("lag") * scale).alias("i"), quadrant_mv(F.col("r"), F.col("lag")).alias("q"), scale.alias("scale"))
    if reps:
        sims = conditional(out, w, ["r"], lambda o, v, t: t * v("r"), lambda o, t: o("r") * t * o("scale"), reps, seed, ["scale"])
        out = local_p(out, sims, "i", "two-sided")
    return out.drop("pos", "r", "scale")
