"""Global spatial autocorrelation: one row a statistic, with analytic moments and, where
``reps`` is given, permutation inference (nodes then need a dense ``pos``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chi2_sf_1, norm_sf, ratio
from .inference import global_sims, summarise
from .weights import lag, row_sums, standardise, summary, transform


def _edges(nodes: DataFrame, weights: DataFrame, *columns: str) -> DataFrame:
    """weights with i_<column> and j_<column> of both ends."""
    a = nodes.select(F.col("id").alias("focal"), *[F.col(c).alias(f"i_{c}") for c in columns])
    b = nodes.select(F.col("id").alias("neighbor"), *[F.col(c).alias(f"j_{c}") for c in columns])
    return weights.join(a.hint("merge"), "focal").join(b.hint("merge"), "neighbor")


def _one(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(F.broadcast(r))
    return out


def moran(nodes: DataFrame, weights: DataFrame, y: str = "y", kind: str = "r", reps: int = 0, seed: int = 42, two_tailed: bool = True, alternative: str = "directed") -> DataFrame:
    """Moran's I, its expectation, both variances, z and p; p_sim and its moments with reps."""
    w = transform(weights, kind)
    z = standardise(nodes.withColumn("y", F.col(y)), "y", scale=False)
    cross = _edges(z, w, "z_y").agg(F.sum(F.col("weight") * F.col("i_z_y") * F.col("j_z_y")).alias("cross"))
    moments = z.agg(F.count("*").cast("double").alias("n"), F.sum(F.pow("z_y", 2)).alias("zz"), F.sum(F.pow("z_y", 4)).alias("z4"))
    s = _one(summary(w), moments, cross)
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    k = ratio(F.col("z4") / n, F.pow(F.col("zz") / n, 2))
    out = s.select("*", ratio(n * F.col("cross"), s0 * F.col("zz")).alias("i"), (-1 / (n - 1)).alias("e_i"))
    out = out.withColumn("v_norm", ratio(n * n * s1 - n * s2 + 3 * s0 * s0, (n * n - 1) * s0 * s0) - F.pow("e_i", 2))
    a = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
    b = k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    out = out.withColumn("v_rand", ratio(a - b, (n - 1) * (n - 2) * (n - 3) * s0 * s0) - F.pow("e_i", 2))
    tails = 2.0 if two_tailed else 1.0
    for v in ("norm", "rand"):
        out = out.withColumn(f"z_{v}", ratio(F.col("i") - F.col("e_i"), F.sqrt(F.when(F.col(f"v_{v}") > 0, F.col(f"v_{v}")))))
        out = out.withColumn(f"p_{v}", norm_sf(F.abs(f"z_{v}")) * tails)
    out = out.select("i", "e_i", "v_norm", "z_norm", "p_norm", "v_rand", "z_rand", "p_rand", "n", "s0", "zz")
    if reps:
        sims = global_sims(z, w, ["z_y"], lambda i, j, x: x * i("z_y") * j("z_y"), reps, seed).crossJoin(F.broadcast(out.select("n", "s0", "zz"))).select("rep", ratio(F.col("n") * F.col("total"), F.col("s0") * F.col("zz")).alias("sim"))
        found = summarise(sims, out, "i", alternative)
        out = _one(out, found.withColumn("p_z_sim", norm_sf(F.abs("z_sim"))))
    return out.drop("n", "s0", "zz")


def moran_bv(nodes: DataFrame, weights: DataFrame, x: str, y: str, kind: str = "r", reps: int = 0, seed: int = 42) -> DataFrame:
    """Bivariate Moran: x against the lag of y, both standardised with n - 1; only y is permuted."""
    w = transform(weights, kind)
    z = standardise(nodes.withColumns({"x": F.col(x), "y": F.col(y)}), "x", "y", ddof=1)
    total = _edges(z, w, "z_x", "z_y").agg(F.sum(F.col("weight") * F.col("i_z_x") * F.col("j_z_y")).alias("t"))
    out = _one(z.agg(F.count("*").alias("n")), total).select(ratio("t", F.col("n") - 1).alias("i"), "n")
    if reps:
        # Permuting y is the same as keeping y and permuting x at the focal end: neighbours
        # stay themselves, so the lag is computed once and the replicates need no edges.
        from .inference import permuted

        lagged = lag(z, w, ly="z_y")
        by_pos = lagged.select("pos", "ly")
        dealt = permuted(z.select("pos", "z_x"), ["z_x"], reps, seed)
        sims = dealt.join(by_pos, "pos").groupBy("rep").agg(F.sum(F.col("z_x") * F.col("ly")).alias("t")).crossJoin(F.broadcast(out.select("n"))).select("rep", ratio("t", F.col("n") - 1).alias("sim"))
        out = _one(out, summarise(sims, out, "i"))
    return out.drop("n")


def moran_bv_matrix(nodes: DataFrame, weights: DataFrame, variables: list[str], kind: str = "r") -> DataFrame:
    """(x, y, i) for all ordered pairs of different variables, in one pass over the edges."""
    w = transform(weights, kind)
    z = standardise(nodes, *variables, ddof=1)
    zs = [f"z_{v}" for v in variables]
    edges = _edges(z, w, *zs)
    pairs = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), (F.col("weight") * F.col(f"i_z_{a}") * F.col(f"j_z_{b}")).alias("t")) for a in variables for b in variables if a != b])
    sums = edges.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.sum("p.t").alias("t"))
    return sums.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n")))).select("x", "y", ratio("t", F.col("n") - 1).alias("i"))


def geary(nodes: DataFrame, weights: DataFrame, y: str = "y", kind: str = "r", reps: int = 0, seed: int = 42) -> DataFrame:
    """Geary's C with both variances; p is one-tailed towards the side of C - 1."""
    w = transform(weights, kind)
    z = standardise(nodes.withColumn("y", F.col(y)), "y", scale=False)
    diff = _edges(z, w, "z_y").agg(F.sum(F.col("weight") * F.pow(F.col("i_z_y") - F.col("j_z_y"), 2)).alias("d"))
    moments = z.agg(F.count("*").cast("double").alias("n"), F.sum(F.pow("z_y", 2)).alias("zz"), F.sum(F.pow("z_y", 4)).alias("z4"))
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    k = ratio(F.col("z4") / n, F.pow(F.col("zz") / n, 2))
    out = _one(summary(w), moments, diff).withColumn("c", ratio((n - 1) * F.col("d"), 2 * s0 * F.col("zz")))
    a = (n - 1) * s1 * (n * n - 3 * n + 3 - (n - 1) * k)
    b = 0.25 * ((n - 1) * s2 * (n * n + 3 * n - 6 - (n * n - n + 2) * k))
    c = s0 * s0 * (n * n - 3 - (n - 1) * (n - 1) * k)
    out = out.withColumn("v_rand", ratio(a - b + c, n * (n - 2) * (n - 3) * s0 * s0))
    out = out.withColumn("v_norm", ratio((2 * s1 + s2) * (n - 1) - 4 * s0 * s0, 2 * (n + 1) * s0 * s0))
    for v in ("norm", "rand"):
        z_v = ratio(F.col("c") - 1, F.sqrt(F.when(F.col(f"v_{v}") > 0, F.col(f"v_{v}"))))
        out = out.withColumn(f"z_{v}", z_v).withColumn(f"p_{v}", norm_sf(F.abs(f"z_{v}")))
    out = out.select("c", F.lit(1.0).alias("e_c"), "v_norm", "z_norm", "p_norm", "v_rand", "z_rand", "p_rand", "n", "s0", "zz")
    if reps:
        sims = global_sims(z, w, ["z_y"], lambda i, j, x: x * F.pow(i("z_y") - j("z_y"), 2), reps, seed).crossJoin(F.broadcast(out.select("n", "s0", "zz"))).select("rep", ratio((F.col("n") - 1) * F.col("total"), 2 * F.col("s0") * F.col("zz")).alias("sim"))
        out = _one(out, summarise(sims, out, "c").withColumn("p_z_sim", norm_sf(F.abs("z_sim"))))
    return out.drop("n", "s0", "zz")


def getis_g(nodes: DataFrame, weights: DataFrame, y: str = "y", reps: int = 0, seed: int = 42) -> DataFrame:
    """Getis-Ord general G over binary weights; p_norm is one-tailed."""
    w = transform(weights, "b")
    d = nodes.withColumn("y", F.col(y).cast("double"))
    cross = _edges(d, w, "y").agg(F.sum(F.col("weight") * F.col("i_y") * F.col("j_y")).alias("cross"))
    sums = d.agg(F.count("*").cast("double").alias("n"), *[F.sum(F.pow("y", i)).alias(f"y{i}") for i in (1, 2, 3, 4)])
    n, s0, s1, s2, y1, y2, y3, y4 = (F.col(c) for c in ("n", "s0", "s1", "s2", "y1", "y2", "y3", "y4"))
    out = _one(summary(w), sums, cross).withColumn("den", y1 * y1 - y2).withColumn("g", ratio("cross", "den")).withColumn("e_g", s0 / (n * (n - 1)))
    b0 = (n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0
    b1 = -((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    b2 = -(2 * n * s1 - (n + 3) * s2 + 6 * s0 * s0)
    b3 = 4 * (n - 1) * s1 - 2 * (n + 1) * s2 + 8 * s0 * s0
    b4 = s1 - s2 + s0 * s0
    top = b0 * y2 * y2 + b1 * y4 + b2 * y1 * y1 * y2 + b3 * y1 * y3 + b4 * F.pow(y1, 4)
    out = out.withColumn("v_g", ratio(top, F.pow("den", 2) * n * (n - 1) * (n - 2) * (n - 3)) - F.pow("e_g", 2))
    out = out.withColumn("z_norm", ratio(F.col("g") - F.col("e_g"), F.sqrt(F.when(F.col("v_g") > 0, F.col("v_g"))))).withColumn("p_norm", norm_sf(F.abs("z_norm")))
    out = out.select("g", "e_g", "v_g", "z_norm", "p_norm", "den")
    if reps:
        sims = global_sims(d, w, ["y"], lambda i, j, x: x * i("y") * j("y"), reps, seed).crossJoin(F.broadcast(out.select("den"))).select("rep", ratio("total", "den").alias("sim"))
        out = _one(out, summarise(sims, out, "g").withColumn("p_z_sim", norm_sf(F.abs("z_sim"))))
    return out.drop("den")


OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "c": lambda a, b: a * b,
    "s": lambda a, b: F.pow(a - b, 2),
    "a": lambda a, b: F.abs(a - b),
}


def gamma(nodes: DataFrame, weights: DataFrame, y: str = "y", operation: str | Callable[[Column, Column], Column] = "c", standardize: bool = False, reps: int = 0, seed: int = 42) -> DataFrame:
    """Gamma index: the sum over edges of weight times a similarity of the ends. The
    similarity is c (product), s (squared difference), a (absolute difference) or a
    function of two columns. Weights are taken as given."""
    op = OPERATIONS[operation] if isinstance(operation, str) else operation
    d = nodes.withColumn("v", F.col(y).cast("double"))
    if standardize:
        d = standardise(d, "v").withColumn("v", F.col("z_v"))
    total = _edges(d, weights, "v").agg(F.sum(F.col("weight") * op(F.col("i_v"), F.col("j_v"))).alias("gamma"))
    if reps:
        sims = global_sims(d, weights, ["v"], lambda i, j, x: x * op(i("v"), j("v")), reps, seed).select("rep", F.col("total").alias("sim"))
        bounds = sims.agg(F.min("sim").alias("min_g"), F.avg("sim").alias("mean_g"), F.max("sim").alias("max_g"))
        found = summarise(sims, total, "gamma", "greater")
        p = F.when(F.col("p_sim") > 0.5, 1 - F.col("p_sim")).otherwise(F.col("p_sim"))
        total = _one(total, found.select(p.alias("p_sim_g"), F.col("z_sim").alias("g_z")), bounds)
    return total


def join_counts(nodes: DataFrame, weights: DataFrame, y: str = "y", reps: int = 0, seed: int = 42) -> DataFrame:
    """Join counts of a binary variable: bb, ww, bw, j, both autocorrelations and Yates'
    chi-square of the 2 x 2 table of joins."""
    w = transform(weights, "b")
    d = nodes.withColumn("y", (F.col(y) == 1).cast("int"))
    i, j = F.col("i_y"), F.col("j_y")

    def counted(x, a, b, name):
        return F.coalesce(F.sum(F.when((i == a) & (j == b), x)), F.lit(0.0)).alias(name)

    x = F.col("weight")
    t = _edges(d, w, "y").agg(counted(x, 1, 1, "t11"), counted(x, 1, 0, "t10"), counted(x, 0, 1, "t01"), counted(x, 0, 0, "t00"), F.sum(x).alias("s0"))
    # The table counts joins, and each join is two edges.
    rows = [(F.col("t11") + F.col("t10")) / 2, (F.col("t01") + F.col("t00")) / 2]
    cols = [(F.col("t11") + F.col("t01")) / 2, (F.col("t10") + F.col("t00")) / 2]
    cells = [("t11", 0, 0), ("t10", 0, 1), ("t01", 1, 0), ("t00", 1, 1)]
    chi = None
    for name, a, b in cells:
        e = ratio(rows[a] * cols[b], F.col("s0") / 2)
        gap = F.abs(F.col(name) / 2 - e)
        part = ratio(F.pow(gap - F.least(F.lit(0.5), gap), 2), e)
        chi = part if chi is None else chi + part
    out = t.select((F.col("t11") / 2).alias("bb"), (F.col("t00") / 2).alias("ww"), ((F.col("t10") + F.col("t01")) / 2).alias("bw"), (F.col("s0") / 2).alias("j"), chi.alias("chi2"))
    out = out.select("*", chi2_sf_1("chi2").alias("chi2_p"), F.lit(1).alias("chi2_dof"), (F.col("bb") + F.col("ww")).alias("autocorr_pos"), F.col("bw").alias("autocorr_neg"))
    if reps:
        sims = global_sims(d, w, ["y"], lambda a, b, x: x * a("y") * b("y"), reps, seed, mixed=lambda a, b, x: x * (a("y") + b("y") - 2 * a("y") * b("y")))
        sims = sims.select("rep", (F.col("total") / 2).alias("bb_sim"), (F.col("mixed") / 2).alias("bw_sim"))
        for stat in ("bb", "bw"):
            found = summarise(sims.select("rep", F.col(f"{stat}_sim").alias("sim")), out, stat, "greater")
            out = _one(out, found.select(F.col("p_sim").alias(f"p_sim_{stat}"), F.col("e_sim").alias(f"mean_{stat}")))
    return out


def lee(nodes: DataFrame, weights: DataFrame, x: str, y: str, kind: str = "o", reps: int = 0, seed: int = 42) -> DataFrame:
    """Lee's L, spatial Pearson correlation: (a, b, l) of the 2 x 2 association matrix, the
    lag cross products over the sum of squared row sums; W'W is never formed. Replicates
    permute whole rows of (x, y)."""
    w = transform(weights, kind)
    z = standardise(nodes.withColumns({"x": F.col(x), "y": F.col(y)}), "x", "y")
    lagged = lag(row_sums(z, w), w, lx="z_x", ly="z_y")
    sums = lagged.agg(F.sum(F.pow("wsum", 2)).alias("d"), F.sum(F.col("lx") * F.col("lx")).alias("xx"), F.sum(F.col("lx") * F.col("ly")).alias("xy"), F.sum(F.col("ly") * F.col("ly")).alias("yy"))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ratio(v, "d").alias("l")) for a, b, v in (("x", "x", "xx"), ("x", "y", "xy"), ("y", "x", "xy"), ("y", "y", "yy"))])
    out = sums.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.l")
    if not reps:
        return out
    from .inference import DIGITS, permuted

    dealt = permuted(z.select("pos", "z_x", "z_y"), ["z_x", "z_y"], reps, seed)
    at = nodes.select("id", "pos")
    edges = w.join(at.withColumnRenamed("id", "neighbor"), "neighbor").select("focal", "pos", "weight")
    per = edges.join(dealt, "pos").groupBy("rep", "focal").agg(F.sum(F.col("weight") * F.col("z_x")).alias("lx"), F.sum(F.col("weight") * F.col("z_y")).alias("ly"))
    per = per.groupBy("rep").agg(F.sum(F.col("lx") * F.col("lx")).alias("xx"), F.sum(F.col("lx") * F.col("ly")).alias("xy"), F.sum(F.col("ly") * F.col("ly")).alias("yy")).crossJoin(F.broadcast(sums.select("d")))
    sims = per.select(F.explode(cells).alias("c")).select("c.a", "c.b", F.col("c.l").alias("s"))
    p = out.join(sims, ["a", "b"]).groupBy("a", "b", "l").agg(F.sum((F.round("s", DIGITS) >= F.round("l", DIGITS)).cast("int")).alias("larger"), F.count("*").alias("r"))
    return p.select("a", "b", "l", ((F.least("larger", F.col("r") - F.col("larger")) + 1) / (F.col("r") + 1)).alias("p_sim"))


def moran_rate(nodes: DataFrame, weights: DataFrame, e: str, b: str, adjusted: bool = True, **options) -> DataFrame:
    """Moran's I of rates e / b, standardised for their variance unless ``adjusted`` is off."""
    from .rates import assuncao_rate

    rated = assuncao_rate(nodes, e, b) if adjusted else nodes.withColumn("r", ratio(e, b))
    return moran(rated, weights, "r", **options)
