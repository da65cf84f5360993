"""Jet-level features: grouped aggregates over constituents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinematics import delta_r
from ..functions.ordering import ROWS_PER_TASK, attach, top_k
from ..schema import CONSTIT_ORDER, GHOST_PT, KEYS


def not_ghost() -> Column:
    return F.col("pt") > GHOST_PT


def jet_first(keys: Sequence[str]) -> list[str]:
    """The keys, jet before event: constituents that come from their merge join lie in the order of the
    jets, so that a sort by these finds its runs instead of mixing the rows by event and back."""
    return [*reversed(keys)]


def _hardest_first(order: Sequence[str]) -> list[Column]:
    return [F.col("pt").desc(), *[F.col(c) for c in order]]


def leading(constits: DataFrame, k: int = 5, keys: Sequence[str] = KEYS,
            order: Sequence[str] = CONSTIT_ORDER) -> DataFrame:
    """Axis (direction of the hardest constituent) and the k largest constituent pT per jet.

    Missing ranks are NULL. Jets made of ghosts only have no row. Ghosts come last in the order and
    are dropped behind the rank, so that the constituents may share a shuffle with other passes.
    """
    top = top_k(constits.select(*keys, "pt", "eta", "phi", *order), keys, _hardest_first(order), k).where(not_ghost())
    pick = lambda c, i: F.max(F.when(F.col("rn") == i, F.col(c)))
    return top.groupBy(*keys).agg(
        pick("eta", 1).alias("eta"), pick("phi", 1).alias("phi"),
        *[pick("pt", i).alias(f"p_t_{i}") for i in range(1, k + 1)])


def jet_core(constits: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = CONSTIT_ORDER) -> DataFrame:
    """pT sum, winner-take-all axis, signal pT and first signal index in one aggregate (partial per
    task, so a hot jet is combined before the shuffle)."""
    live, sig = not_ghost(), F.col("user_index") > 0
    head = F.max(F.when(live, F.struct("pt", *[(-F.col(c)).alias(f"_{c}") for c in order], "eta", "phi")))
    first = F.min(F.when(live & sig, F.struct(*order, "user_index")))
    agg = constits.groupBy(*keys).agg(
        F.sum("pt").alias("p_t"), head.alias("_h"), first.alias("_f"),
        F.sum(F.when(live & (F.col("user_index") != 0), F.col("pt")).otherwise(0.0)).alias("tru_sum"))
    return agg.select(*keys, "p_t", F.col("_h.eta").alias("eta"), F.col("_h.phi").alias("phi"), "tru_sum",
                      F.coalesce("_f.user_index", F.lit(0)).alias("first_signal"))


def truth_core(constits: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = CONSTIT_ORDER) -> DataFrame:
    """What truth matching needs of a jet and of the truth jet inside it (its signal constituents),
    in one aggregate: axis, signal pT and first signal index, the truth jet's pT and axis (NULL
    without one), and the distinct signal indices that it holds."""
    live = not_ghost()
    hit = live & (F.col("user_index") > 0)
    head = F.struct("pt", *[(-F.col(c)).alias(f"_{c}") for c in order], "eta", "phi")
    agg = constits.groupBy(*jet_first(keys)).agg(
        F.max(F.when(live, head)).alias("_h"), F.max(F.when(hit, head)).alias("_t"),
        F.min(F.when(hit, F.struct(*order, "user_index"))).alias("_f"),
        F.sum(F.when(live & (F.col("user_index") != 0), F.col("pt")).otherwise(0.0)).alias("tru_sum"),
        F.sum(F.when(hit, F.col("pt"))).alias("truth_pt"), F.collect_set(F.when(hit, F.col("user_index"))).alias("indices"))
    return agg.select(*keys, F.col("_h.eta").alias("eta"), F.col("_h.phi").alias("phi"), "tru_sum",
                      F.coalesce("_f.user_index", F.lit(0)).alias("first_signal"), "truth_pt",
                      F.col("_t.eta").alias("truth_eta"), F.col("_t.phi").alias("truth_phi"), "indices")


def jet_axis(constits: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = CONSTIT_ORDER) -> DataFrame:
    """Winner-take-all recombination: summed pT, direction of the hardest constituent."""
    return jet_core(constits, keys, order).select(*keys, "p_t", "eta", "phi")


def track_counts(constits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return constits.groupBy(*keys).agg(F.count_if(not_ghost()).alias("n_trk"))


def pt_moments(constits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    pt = F.when(not_ghost(), F.col("pt"))
    return constits.groupBy(*keys).agg(F.avg(pt).alias("mean_p_t"), F.var_pop(pt).alias("var_p_t"))


def leading_minus_subleading(constits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    lead = leading(constits, 2, keys)
    return lead.where(F.col("p_t_2").isNotNull()).select(*keys, (F.col("p_t_1") - F.col("p_t_2")).alias("lesub"))


def fragmentation(constits: DataFrame, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Momentum share of every non-ghost constituent: the jet sum is combined map-side and attached
    back to the rows."""
    sums = constits.groupBy(*keys).agg(F.sum("pt").alias("p_t"))
    return attach(constits.where(not_ghost()), sums, keys, **kw).withColumn("z", F.try_divide("pt", "p_t"))


def with_axis(constits: DataFrame, axis: DataFrame, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Constituents with their jet axis and distance to it."""
    named = axis.select(*keys, F.col("eta").alias("axis_eta"), F.col("phi").alias("axis_phi"))
    return attach(constits, named, keys, **kw).withColumn(
        "dr", delta_r(F.col("eta"), F.col("phi"), F.col("axis_eta"), F.col("axis_phi")))


def angularity(constits: DataFrame, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Momentum-weighted and plain mean distance to the axis."""
    near = with_axis(constits.where(not_ghost()), jet_axis(constits, keys), keys, **kw)
    return near.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pt") * F.col("dr")), F.sum("pt")).alias("angularity"),
        F.avg("dr").alias("angularity_nw"))


def signal_sums(constits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    real = F.col("user_index") != 0
    out = constits.where(not_ghost()).groupBy(*keys).agg(
        F.sum(F.when(real, F.col("pt")).otherwise(0.0)).alias("tru_sum"),
        F.sum(F.when(~real, F.col("pt")).otherwise(0.0)).alias("fake_sum"),
        F.count("*").alias("n"), F.sum("pt").alias("p_t"))
    return out.select(
        *keys, "tru_sum", "fake_sum",
        (F.col("tru_sum") / F.col("n")).alias("x_tru"), (F.col("fake_sum") / F.col("n")).alias("x_fake"),
        F.try_divide("tru_sum", "p_t").alias("x_tru_share"))


def first_signal(constits: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = CONSTIT_ORDER) -> DataFrame:
    """Origin index of the first signal constituent in list order, 0 when there is none."""
    hit = not_ghost() & (F.col("user_index") > 0)
    idx = F.min(F.when(hit, F.struct(*order, "user_index")))
    return constits.groupBy(*keys).agg(F.coalesce(idx["user_index"], F.lit(0)).alias("first_signal"))


def origin_columns() -> dict[str, Column]:
    """pT of a constituent by where it came from."""
    live, sig = not_ghost(), F.col("user_index") != 0
    kf = F.col("origin_kf")
    gluon = kf.isin(21, 9)
    part = lambda cond: F.sum(F.when(live & cond, F.col("pt")).otherwise(0.0))
    return {
        "quark": part(sig & (kf != 2212) & ~gluon), "gluon": part(sig & gluon),
        "beam": part(sig & (kf == 2212)), "bkgd": part(~sig),
    }


def origin_fractions(constits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    parts = origin_columns()
    agg = constits.groupBy(*keys).agg(F.sum("pt").alias("p_t"), *[c.alias(n) for n, c in parts.items()])
    return agg.select(*keys, "p_t", *[F.try_divide(n, "p_t").alias(f"y_{n}") for n in parts])


def origin_class(constits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """1 pure beam, 2 mixed, 3 pure parton, over signal constituents; NULL for background jets."""
    sig = not_ghost() & (F.col("user_index") != 0)
    beam = F.col("origin_kf") == 2212
    agg = constits.groupBy(*keys).agg(
        F.coalesce(F.bool_or(sig & beam), F.lit(False)).alias("has_beam"),
        F.coalesce(F.bool_or(sig & ~beam), F.lit(False)).alias("has_parton"))
    b, p = F.col("has_beam"), F.col("has_parton")
    return agg.select(*keys, F.when(b & p, 2).when(b, 1).when(p, 3).alias("origin_class"))


def subjet_share(constits: DataFrame, pitch: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Hardest sub-cluster over the signal pT of the jet, sub-clusters being (eta, phi) cells; -1
    without signal."""
    sig = not_ghost() & (F.col("user_index") != 0)
    cells = constits.groupBy(*keys, F.floor(F.col("eta") / pitch).alias("ce"), F.floor(F.col("phi") / pitch).alias("cp")).agg(
        F.sum(F.when(sig, F.col("pt")).otherwise(0.0)).alias("cell_pt"))
    return cells.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.max("cell_pt"), F.nullif(F.sum("cell_pt"), F.lit(0.0))), F.lit(-1.0)).alias("z_subjet"))


def jet_features(constits: DataFrame, carry: Sequence[str] = ("pt_hard_min", "r_idx"),
                 keys: Sequence[str] = KEYS, *, rows_per_task: int = ROWS_PER_TASK, probe: DataFrame | None = None) -> DataFrame:
    """The whole per-jet block in two passes over the constituents.

    The first keeps only the five hardest rows per jet and task (group limit) and yields axis and
    leading pT. The second joins the axis back on the jet key and aggregates everything else in the
    same stage. Both read the same columns (the signal index is the last tie-break of the first), so
    that constituents that come from a join are shuffled once for both. Hot jets are joined by broadcast and aggregated
    where their rows lie, so only partial sums move.
    """
    by = jet_first(keys)
    lead = leading(constits, 5, by, (*CONSTIT_ORDER, "user_index")).select(
        *by, F.col("eta").alias("axis_eta"), F.col("phi").alias("axis_phi"), *[f"p_t_{i}" for i in range(1, 6)])
    live = not_ghost()
    pt = F.when(live, F.col("pt"))
    dr = delta_r(F.col("eta"), F.col("phi"), F.col("axis_eta"), F.col("axis_phi"))
    sig = F.col("user_index") != 0
    parts = origin_columns()
    near = attach(constits, lead, by, rows_per_task=rows_per_task, probe=probe)
    agg = near.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in carry],
        F.sum("pt").alias("p_t"), F.count_if(live).alias("n_trk"),
        F.max("axis_eta").alias("eta"), F.max("axis_phi").alias("phi"),
        F.sum(pt * dr).alias("_ang"), F.avg(F.when(live, dr)).alias("angularity_nw"),
        F.avg(pt).alias("mean_p_t"), F.var_pop(pt).alias("var_p_t"),
        *[F.max(f"p_t_{i}").alias(f"p_t_{i}") for i in range(1, 6)],
        F.sum(F.when(live & sig, F.col("pt")).otherwise(0.0)).alias("tru_sum"),
        *[c.alias(f"_{n}") for n, c in parts.items()])
    return agg.select(
        *keys, *carry, "p_t", "eta", "phi", "n_trk",
        F.try_divide("_ang", "p_t").alias("angularity"), "angularity_nw", "mean_p_t", "var_p_t",
        *[f"p_t_{i}" for i in range(1, 6)],
        F.try_divide(F.col("tru_sum"), F.col("n_trk")).alias("x_tru"),
        *[F.try_divide(f"_{n}", "p_t").alias(f"y_{n}") for n in parts], "tru_sum")
