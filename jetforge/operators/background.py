"""Event-level background: density medians, subtraction, ranks, gates and pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import HotGroups, ROWS_PER_TASK, attach, grouped_quantiles, hot_groups, match, ranked, top_k
from ..schema import GHOST_PT, KEYS
from ..session import stored


def epsilon(jets: DataFrame) -> DataFrame:
    return jets.withColumn("epsilon", F.try_divide("p_t", "area"))


# Which jets of an event enter each density median.
_MEDIANS = {
    "rho_all": ("all", "live"), "rho_all_ghosts": ("all", "any"),
    "rho_drop2": ("rest", "live"), "rho_drop2_ghosts": ("rest", "any"),
}


def _with_rank(jets: DataFrame) -> DataFrame:
    """Jets with density, "not among the dropped leaders" and "not a ghost" flags, by windows over
    the event. Leaders are the min(2, n-1) jets of largest pT, ghosts included."""
    order = Window.partitionBy("event_id").orderBy(F.col("p_t").desc(), F.col("jet_id"))
    whole = Window.partitionBy("event_id")
    return (epsilon(jets).withColumn("_rn", F.row_number().over(order)).withColumn("_n", F.count("*").over(whole))
            .withColumn("_rest", F.col("_rn") > F.least(F.lit(2), F.col("_n") - 1))
            .withColumn("_live", F.col("p_t") > GHOST_PT))


def _in(name: str) -> Column:
    span, ghosts = _MEDIANS[name]
    cond = F.col("_rest") if span == "rest" else F.lit(True)
    return cond & F.col("_live") if ghosts == "live" else cond


def drop_leading(jets: DataFrame, k: int = 2) -> DataFrame:
    """Jets without the leading min(k, n-1) of their event by pT, without holding an event in a task.

    Only the k leaders of an event (limited per task ahead of the shuffle) and its jet count are
    computed; leaders are removed with an anti join on the full jet key.
    """
    lead = top_k(jets.select(*KEYS, "p_t"), ["event_id"], [F.col("p_t").desc(), F.col("jet_id")], k)
    count = jets.groupBy("event_id").agg(F.count("*").alias("_n"))
    gone = lead.join(count, "event_id").where(F.col("rn") <= F.least(F.lit(k), F.col("_n") - 1)).select(*KEYS)
    return jets.join(gone, KEYS, "left_anti")


def _parted(jets: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame | None]:
    """Jets of ordinary events, and those of hot events written once. The list of hot events is
    bounded by the screen and goes to the jets."""
    if not hot.count:
        return jets, None
    listed = F.broadcast(stored(hot.frame, "hot-events"))
    return match(jets, listed, ["event_id"], "left_anti"), stored(match(jets, listed, ["event_id"], "left_semi"), "hot-jets")


def _hot_medians(jets: DataFrame, names: Sequence[str], rows_per_task: int) -> DataFrame:
    """The medians for events too large for one task."""
    out = jets.select("event_id").distinct()
    for name in names:
        span, ghosts = _MEDIANS[name]
        rows = drop_leading(jets) if span == "rest" else jets
        rows = epsilon(rows.where(F.col("p_t") > GHOST_PT) if ghosts == "live" else rows)
        med = grouped_quantiles(rows, ["event_id"], "epsilon", {name: 0.5}, rows_per_task=rows_per_task)
        out = out.join(med, "event_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def density_medians(jets: DataFrame, names: Sequence[str] = tuple(_MEDIANS), *, rows_per_task: int = ROWS_PER_TASK,
                    sizes: DataFrame | None = None) -> DataFrame:
    """Median pT density per event over all jets or without two leaders, with ghost jets in or out;
    0 where no jet is left. All medians share one pass over the jets. Events above ``rows_per_task``
    jets take the distributed path."""
    hot = hot_groups(jets, ["event_id"], rows_per_task, sizes)
    ordinary, big = _parted(jets, hot)
    med = _with_rank(ordinary).groupBy("event_id").agg(*[
        F.coalesce(F.percentile(F.when(_in(n), F.col("epsilon")), F.lit(0.5)), F.lit(0.0)).alias(n) for n in names])
    if not hot.count:
        return med
    return med.unionByName(_hot_medians(big, names, rows_per_task))


def rho_median(jets: DataFrame, *, ghosts: bool = True, name: str = "rho", **kw) -> DataFrame:
    pick = "rho_all_ghosts" if ghosts else "rho_all"
    return density_medians(jets, [pick], **kw).withColumnRenamed(pick, name)


def rho_median_drop2(jets: DataFrame, *, ghosts: bool = True, name: str = "rho", **kw) -> DataFrame:
    pick = "rho_drop2_ghosts" if ghosts else "rho_drop2"
    return density_medians(jets, [pick], **kw).withColumnRenamed(pick, name)


def with_rho_drop2(jets: DataFrame, *, rows_per_task: int = ROWS_PER_TASK, sizes: DataFrame | None = None) -> DataFrame:
    """Jets with the drop-2 median of their event. One shuffle by event serves rank, count, median
    and attachment; only events above ``rows_per_task`` jets go through a median table and a join."""
    hot = hot_groups(jets, ["event_id"], rows_per_task, sizes)
    ordinary, big = _parted(jets, hot)
    med = F.percentile(F.when(F.col("_rest"), F.col("epsilon")), F.lit(0.5)).over(Window.partitionBy("event_id"))
    out = _with_rank(ordinary).withColumn("rho", F.coalesce(med, F.lit(0.0))).select(*jets.columns, "rho")
    if not hot.count:
        return out
    rho = _hot_medians(big, ["rho_drop2_ghosts"], rows_per_task).withColumnRenamed("rho_drop2_ghosts", "rho")
    # As many rows as there are hot events: bounded by the screen.
    return out.unionByName(match(big, F.broadcast(rho), ["event_id"]))


def attach_rho(jets: DataFrame, rho: DataFrame, **kw) -> DataFrame:
    return attach(jets, rho, ["event_id"], **kw)


def pt_corr(jets: DataFrame, rho: str = "rho") -> DataFrame:
    return jets.withColumn("p_t_corr", F.col("p_t") - F.col(rho) * F.col("area"))


def ghost_stats(jets: DataFrame, **kw) -> DataFrame:
    """Share of all-ghost jets per event, and the four density medians."""
    share = jets.groupBy("event_id").agg(
        F.count("*").alias("n_jets"), F.count_if(F.col("n_trk") == 0).alias("n_ghost"),
        F.avg((F.col("n_trk") == 0).cast("double")).alias("ghost_share"))
    return share.join(density_medians(jets, **kw), "event_id")


def jet_rank(jets: DataFrame, *, rows_per_task: int = ROWS_PER_TASK, sizes: DataFrame | None = None) -> DataFrame:
    """Position of a jet in its event by descending pT."""
    return ranked(jets, ["event_id"], "p_t", "jet_id", descending=True, name="jet_rank",
                  rows_per_task=rows_per_task, sizes=sizes)


def event_gate(rows: DataFrame, selected: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of events with at least one selected jet (or of events with none)."""
    return rows.join(selected.select("event_id").distinct(), "event_id", "left_semi" if keep else "left_anti")


def event_zip(signal: DataFrame, background: DataFrame, *, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pair the k-th signal event with the k-th background event, by id order; the longer side is
    cut off where the shorter ends."""
    def ordinal(df, name):
        ids = df.select(F.col("event_id").alias(name), F.lit(0).alias("_z")).distinct()
        return ranked(ids, [], name, "_z", name="ordinal", rows_per_task=rows_per_task).drop("_z")

    return ordinal(signal, "signal_event").join(ordinal(background, "background_event"), "ordinal")


def event_plane(particles: DataFrame, n_max: int = 5) -> DataFrame:
    """Event-plane angle of each harmonic."""
    sums = []
    for n in range(1, n_max + 1):
        sums += [F.sum(F.col("pt") * F.sin(F.col("phi") * n)).alias(f"s{n}"),
                 F.sum(F.col("pt") * F.cos(F.col("phi") * n)).alias(f"c{n}")]
    agg = particles.groupBy("event_id").agg(*sums)
    return agg.select("event_id", *[
        ((F.pi() + F.atan2(-F.col(f"s{n}"), -F.col(f"c{n}"))) / n).alias(f"psi_{n}") for n in range(1, n_max + 1)])
