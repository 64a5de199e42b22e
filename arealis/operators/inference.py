"""Permutation inference without random state: replicates are ranked by md5, so every
engine that has md5 draws the same ones.

Global: replicate r gives the node at position k the value of the node that ranks k-th by
md5(seed:r:position). Local: for each replicate and slot one number below n - 1 is drawn
without replacement, shared by all sites; number d means the d-th position when the site
itself is left out. So the draws, not the sites, are the table that grows with replicates:
their values are looked up once, and sites meet them in one broadcast row whose size is
replicates times the largest number of neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import p_of_array

DIGITS = 10  # replicates are compared with the statistic after rounding: a tie is a tie in every engine
BROADCAST_ROWS = 4_000_000
FEW_DRAWS = 200_000  # up to so many draws are gathered in the driver
MOST_SLOTS = 16  # up to so many neighbours are summed in one compiled expression


def rank_text(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def permuted(nodes: DataFrame, values: list[str], reps: int, seed: int = 42) -> DataFrame:
    """(rep, pos, values...): ``values`` of nodes(pos, ...) dealt anew in each replicate."""
    spark = nodes.sparkSession
    base = nodes.select("pos", *values)
    order = Window.partitionBy("rep").orderBy(rank_text(seed, F.col("rep"), F.col("pos")), "pos")
    return spark.range(reps).select(F.col("id").alias("rep")).crossJoin(base).select("rep", (F.row_number().over(order) - 1).cast("long").alias("pos"), *values)


def global_sims(nodes: DataFrame, weights: DataFrame, values: list[str], term: Callable[[Callable, Callable, Column], Column], reps: int, seed: int = 42, **more: Callable[[Callable, Callable, Column], Column]) -> DataFrame:
    """(rep, total): the sum over edges of ``term(i, j, w)`` in each replicate; i and j map
    a column name to the permuted value at the focal and the neighbour. ``more`` adds
    further sums by name."""
    at = nodes.select("id", "pos")
    edges = weights.join(at.select(F.col("id").alias("focal"), F.col("pos").alias("fp")), "focal").join(at.select(F.col("id").alias("neighbor"), F.col("pos").alias("np")), "neighbor").select("fp", "np", "weight")
    dealt = permuted(nodes, values, reps, seed)
    a = dealt.select("rep", F.col("pos").alias("fp"), *[F.col(v).alias(f"i_{v}") for v in values])
    b = dealt.select("rep", F.col("pos").alias("np"), *[F.col(v).alias(f"j_{v}") for v in values])
    joined = edges.join(a, "fp").join(b, ["rep", "np"])
    terms = {"total": term, **more}
    return joined.groupBy("rep").agg(*[F.sum(t(lambda v: F.col(f"i_{v}"), lambda v: F.col(f"j_{v}"), F.col("weight"))).alias(k) for k, t in terms.items()])


def summarise(sims: DataFrame, observed: DataFrame, stat: str, alternative: str = "directed") -> DataFrame:
    """One row: p_sim, e_sim, se_sim, v_sim, z_sim of ``sims(rep, sim)`` against column
    ``stat`` of the one-row ``observed``."""
    rows = sims.crossJoin(F.broadcast(observed.select(F.col(stat).alias("obs"))))
    out = rows.groupBy("obs").agg(F.collect_list(F.round("sim", DIGITS)).alias("sims"), F.avg("sim").alias("e_sim"), F.stddev_pop("sim").alias("se_sim"))
    return out.select(
        F.size("sims").cast("long").alias("reps"), p_of_array(F.round("obs", DIGITS), F.col("sims"), alternative).alias("p_sim"),
        "e_sim", "se_sim", F.pow("se_sim", 2).alias("v_sim"), F.try_divide(F.col("obs") - F.col("e_sim"), F.col("se_sim")).alias("z_sim"),
    )


def draws(n: Column | int, max_card: int, reps: int, nodes: DataFrame, seed: int = 42) -> DataFrame:
    """(rep, slot, draw) for slots 1..max_card: draws below n - 1 without replacement.
    Only the lowest ``max_card`` ranks of a replicate are wanted: draws above a bound that
    leaves enough of them are dropped as they are made, and the bound is raised until each
    replicate has its number. Many wanted draws are sorted instead."""
    spark = nodes.sparkSession
    size = nodes.agg(F.max("pos")).first()[0] or 0
    dealt = spark.range(size).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    dealt = dealt.select("rep", "draw", rank_text(seed, F.col("rep"), F.col("draw")).alias("rank"))
    wanted, spare = min(max_card, size), 10 * max_card**0.5 + 40
    while (max_card + spare) * reps <= FEW_DRAWS and max_card + spare < size:
        bound = f"{int((max_card + spare) / size * 16**12):012x}"
        dealt_low = dealt.where(F.col("rank") < bound)
        found: dict[int, list[tuple[str, int]]] = {r: [] for r in range(reps)}
        for rep, draw, rank in dealt_low.collect():
            found[rep].append((rank, draw))
        if all(len(f) >= wanted for f in found.values()):
            rows = [(rep, k + 1, draw) for rep, f in found.items() for k, (_, draw) in enumerate(sorted(f)[:max_card])]
            return spark.createDataFrame(rows, "rep long, slot int, draw long")
        spare *= 4
    order = Window.partitionBy("rep").orderBy("rank", "draw")
    return dealt.select("rep", F.row_number().over(order).alias("slot"), "draw").where(F.col("slot") <= max_card)


def conditional(
    nodes: DataFrame, weights: DataFrame, values: list[str], term: Callable[[Callable, Callable, Column], Column],
    finish: Callable[[Callable, Column], Column], reps: int = 99, seed: int = 42, keep: list[str] | None = None,
) -> DataFrame:
    """(id, rep, sim): conditional randomisation. Each site keeps its own values and gets
    drawn ones for its neighbours: the sum over edges of ``term(own, drawn, weight)``, then
    ``finish(own, sum)``. Self-weights are no draws; sites without neighbours get a sum of
    0. ``keep`` names further columns of nodes that ``own`` may use. Edges take slots in
    the order of their neighbours' positions. The frame's ``beside`` returns the
    replicates with columns of another table of sites."""
    own_cols = sorted({*values, *(keep or [])})
    pos = nodes.select(F.col("id").alias("neighbor"), F.col("pos").alias("np"))
    near = F.array_sort(F.collect_list(F.struct("np", "weight")))
    lists = weights.where("focal <> neighbor").join(pos.hint("merge"), "neighbor").groupBy(F.col("focal").alias("id")).agg(near.alias("slots"))
    largest = lists.agg(F.max(F.size("slots"))).first()[0] or 0
    own = nodes.select("id", "pos", *[F.col(c).alias(f"o_{c}") for c in own_cols])
    sites = own.join(lists.hint("merge"), "id", "left").withColumn("slots", F.coalesce("slots", F.array()))
    d = draws(0, max(largest, 1), reps, nodes, seed)
    here = nodes.select(F.col("pos").alias("draw"), *[F.col(v).alias(f"a_{v}") for v in values])
    following = nodes.select((F.col("pos") - 1).alias("draw"), *[F.col(v).alias(f"b_{v}") for v in values])
    table = d.join(here.hint("shuffle_hash"), "draw", "left").join(following.hint("shuffle_hash"), "draw", "left")
    mine = lambda c: F.col(f"o_{c}")
    if largest * reps > BROADCAST_ROWS:
        edges = sites.select(*own.columns, F.posexplode_outer("slots").alias("slot", "s")).withColumn("slot", F.col("slot") + 1).withColumn("weight", F.col("s.weight"))
        drawn = lambda v: F.when(F.col("draw") >= F.col("pos"), F.col(f"b_{v}")).otherwise(F.col(f"a_{v}"))
        islands = edges.where("slot is null").crossJoin(F.broadcast(nodes.sparkSession.range(reps).select(F.col("id").alias("rep")))).select(*own.columns, "rep", F.lit(0.0).alias("total"))
        sums = edges.join(table, "slot").groupBy(*own.columns, "rep").agg(F.sum(term(mine, drawn, F.col("weight"))).alias("total"))
        return sums.unionByName(islands).select("id", "rep", finish(mine, F.col("total")).alias("sim"))
    # One row holds all draws, by replicate and slot; each site meets it and sums its few
    # slots in an expression, so what belongs to a site stays together and in one partition.
    columns = [c for c in table.columns if c not in ("rep", "slot")]
    by_rep = table.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("slot", *columns))).alias("cells"))
    deal = by_rep.agg(F.array_sort(F.collect_list(F.struct("rep", "cells"))).alias("deal"))

    def one(s: Column, c: Column) -> Column:
        return term(mine, lambda v: F.when(c["draw"] >= F.col("pos"), c[f"b_{v}"]).otherwise(c[f"a_{v}"]), s["weight"]).cast("double")

    if largest <= MOST_SLOTS:
        terms = [F.when(F.size("slots") > k, one(F.get("slots", F.lit(k)), F.get("t.cells", F.lit(k)))) for k in range(max(largest, 1))]
        known, total = F.coalesce(*terms).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in terms), F.lit(0.0))
        total = F.when(known | (F.size("slots") == 0), total)
    else:
        terms = F.zip_with("slots", F.slice("t.cells", F.lit(1), F.size("slots")), one)
        total = F.when(F.size("slots") == 0, 0.0).otherwise(F.aggregate(terms, F.lit(None).cast("double"), lambda t, x: F.coalesce(t + x, t, x)))

    def beside(observed: DataFrame | None = None) -> DataFrame:
        """(id, rep, sim, ...): the replicates beside columns of ``observed(id, ...)``."""
        rows = sites if observed is None else sites.join(observed.hint("merge"), "id")
        more = [c for c in (observed.columns if observed is not None else []) if c != "id"]
        dealt = rows.crossJoin(F.broadcast(deal)).select(*own.columns, "slots", *more, F.explode("deal").alias("t"))
        return dealt.select("id", F.col("t.rep").alias("rep"), finish(mine, total).alias("sim"), *more)

    out = beside()
    out.beside = beside
    return out


def local_p(observed: DataFrame, sims: DataFrame, stat: str, alternative: str = "directed") -> DataFrame:
    """Add p_sim, e_sim, se_sim, v_sim, z_sim and p_z_sim to ``observed(id, stat, ...)``.
    For the counting alternatives the replicates are folded as they come, without arrays,
    and those of ``conditional`` where they are made: no row a replicate is shuffled."""
    from ..functions.columns import norm_sf, p_of_counts

    obs = observed.select("id", F.round(stat, DIGITS).alias("obs"))
    rows = sims.beside(obs) if hasattr(sims, "beside") else sims.join(obs, "id")
    sim = F.round("sim", DIGITS)
    apart = F.abs(F.col("sim") - F.col("obs")) > 10.0 ** (1 - DIGITS)  # then rounding decides nothing
    if alternative in ("directed", "greater", "lesser"):
        agg = rows.groupBy("id").agg(
            F.sum(F.when(apart, F.col("sim") > F.col("obs")).otherwise(sim >= F.col("obs")).cast("int")).alias("larger"), F.sum(F.when(apart, F.col("sim") < F.col("obs")).otherwise(sim <= F.col("obs")).cast("int")).alias("less"), F.count("*").alias("reps"), F.avg("sim").alias("e_sim"), F.stddev_pop("sim").alias("se_sim")
        )
        agg = agg.withColumn("p_sim", p_of_counts(F.col("larger"), F.col("less"), F.col("reps"), alternative)).drop("larger", "less", "reps")
    else:
        agg = rows.groupBy("id", "obs").agg(F.collect_list(sim).alias("sims"), F.avg("sim").alias("e_sim"), F.stddev_pop("sim").alias("se_sim"))
        agg = agg.withColumn("p_sim", p_of_array(F.col("obs"), F.col("sims"), alternative)).drop("sims", "obs")
    z = F.try_divide(F.col(stat) - F.col("e_sim"), F.col("se_sim"))
    return observed.join(agg.hint("merge"), "id", "left").withColumn("v_sim", F.pow("se_sim", 2)).withColumn("z_sim", z).withColumn("p_z_sim", norm_sf(F.abs("z_sim")))


def fdr(p_values: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """One row, ``cutoff``: the largest i * alpha / n above the i-th smallest p-value, or
    alpha / n. Ranks come from counts of distinct p-values, so rows are not sorted in one
    task unless all p-values differ; permutation p-values have few distinct ones."""
    counts = p_values.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("k"))
    n = p_values.agg(F.count(p).alias("n"))
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.where("p is not null").withColumn("hi", F.sum("k").over(w)).crossJoin(F.broadcast(n))
    # Equal p-values take ranks hi-k+1..hi; the largest rank gives the largest bound.
    bound = F.col("hi") * alpha / F.col("n")
    return ranked.agg(F.coalesce(F.max(F.when(F.col("p") < bound, bound)), F.lit(alpha) / F.max("n")).alias("cutoff"))
