"""Matching, unions, lineage, cones and lookups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinematics import delta_r
from ..functions.ordering import ROWS_PER_TASK, attach, hot_groups
from ..schema import KEYS
from ..session import ensure_checkpoint_dir, stored
from . import jets as J

NO_MATCH_DISTANCE = 1e6

# Particle masses in GeV by absolute species code.
SPECIES_MASS = [(211, 0.13957), (321, 0.493677), (2212, 0.938272), (111, 0.134977)]


def species_mass(df: DataFrame, kf: str = "kf") -> DataFrame:
    """Mass by species code; unknown codes give NULL. Four constants, so a literal map is enough."""
    table = F.create_map(*[F.lit(v) for pair in SPECIES_MASS for v in pair])
    return df.withColumn("mass", F.try_element_at(table, F.abs(F.col(kf)).cast("int")))


def truth_match(constits: DataFrame, *, rows_per_task: int = ROWS_PER_TASK, event_sizes: DataFrame | None = None) -> DataFrame:
    """Distance and momentum share of the truth jet matched to each jet.

    A jet is matched through its first signal index to the hardest truth jet of the event holding
    that index. The hardest holder is found per (event, index) before the join, so each jet meets
    one row instead of all truth jets of its event. One shuffle of the jets by event serves both;
    only with events above ``rows_per_task`` jets do the hardest holders go through a table.
    """
    jets = J.truth_core(constits)
    # Descending pT, then ascending id. Rows without a key match nothing.
    named = F.col("event_id").isNotNull() & F.col("jet_id").isNotNull() & (F.col("index") > 0)
    hardest = F.max(F.when(named, F.struct("truth_pt", (-F.col("jet_id")).alias("neg_id"), "truth_eta", "truth_phi")))
    own = [*KEYS, "first_signal", "eta", "phi", "tru_sum"]
    found = [(-F.col("t.neg_id")).alias("truth_jet"), "t.truth_pt", "t.truth_eta", "t.truth_phi"]
    # Any (event, index) group is at most its event.
    if hot_groups(jets, ["event_id"], rows_per_task, event_sizes).count:
        jets = stored(jets, "truth-jets")
        holders = jets.select("*", F.explode("indices").alias("index"))
        best = holders.groupBy("event_id", F.col("index").alias("first_signal")).agg(hardest.alias("t"))
        out = attach(jets.select(*own), best, ["event_id", "first_signal"], rows_per_task=rows_per_task).select(*own, *found)
    else:
        each = jets.repartition("event_id").select(
            "*", F.explode(F.array_union("indices", F.array("first_signal"))).alias("index"))
        seen = each.withColumn("t", hardest.over(Window.partitionBy("event_id", "index")))
        out = seen.where(F.col("index") == F.col("first_signal")).select(*own, *found)
    dist = delta_r(F.col("eta"), F.col("phi"), F.col("truth_eta"), F.col("truth_phi"))
    return out.select(
        *KEYS, "first_signal", "truth_jet",
        F.coalesce(dist, F.lit(NO_MATCH_DISTANCE)).alias("dist_match"),
        F.coalesce(F.try_divide("tru_sum", "truth_pt"), F.lit(0.0)).alias("x_match"))


def union_sources(signal: DataFrame, background: DataFrame) -> DataFrame:
    """Signal and background constituents in one table; background rows carry index 0."""
    bkgd = background.withColumn("user_index", F.lit(0).cast("int")).withColumn("source", F.lit("background"))
    return signal.withColumn("source", F.lit("signal")).unionByName(bkgd, allowMissingColumns=True)


def concat_classes(slices: Sequence[DataFrame]) -> DataFrame:
    out = slices[0]
    for s in slices[1:]:
        out = out.unionByName(s)
    return out


def lineage_root(nodes: DataFrame, *, node: str = "id", parent: str = "parent", groups: Sequence[str] = (),
                 top: int = 8) -> DataFrame:
    """Follow parents until an index of at most ``top``.

    Pointer doubling: every round replaces a row's pointer by its pointer's pointer, so chains of
    length 2**rounds resolve. Each round is one equi join and ends in a checkpoint to keep the
    lineage flat. No chain is longer than the table, so after enough rounds for that only cycles
    are left. Rows that end at 0 or NULL, at a missing node or in a cycle get ``status`` 'error'.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    g = list(groups)
    done = F.col("ptr") <= top
    up = F.coalesce(parent, F.lit(0))
    cur = nodes.select(*g, node, up.alias("ptr"), F.lit(1).cast("long").alias("hops"), up.between(1, top).alias("prompt")).checkpoint()
    for _ in range(cur.count().bit_length() + 1):
        step = cur.select(*g, F.col(node).alias("ptr"), F.col("ptr").alias("next_ptr"), F.col("hops").alias("next_hops"))
        live = cur.where(~done)
        if live.isEmpty():
            break
        moved = live.join(step, [*g, "ptr"], "left").select(
            *g, node, F.coalesce("next_ptr", F.lit(0)).alias("ptr"),
            (F.col("hops") + F.coalesce("next_hops", F.lit(0))).alias("hops"), "prompt")
        cur = cur.where(done).unionByName(moved).checkpoint()
    ok = F.col("ptr").between(1, top)
    # A row in a cycle has gone round many times; its hops stop at the largest integer.
    hops = F.least("hops", F.lit(2**31 - 1)).cast("int").alias("hops")
    return cur.select(*g, node, F.when(ok, F.col("ptr")).alias("root"), hops,
                      F.when(ok & F.col("prompt"), "prompt").when(ok, "resolved").otherwise("error").alias("status"))


def _neighbour_cells(eta: Column, phi: Column, side: float, n_phi: int) -> Column:
    """The 3x3 block of cells around a point; azimuth wraps."""
    ce, cp = F.floor(eta / side), F.floor(phi / (F.lit(2 * math.pi) / n_phi))
    cells = []
    for de in (-1, 0, 1):
        for dp in (-1, 0, 1):
            cells.append(F.struct((ce + de).alias("ce"), F.pmod(cp + dp, F.lit(n_phi)).alias("cp")))
    return F.array_distinct(F.array(*cells))


def cone_assign(particles: DataFrame, seeds: DataFrame, radius: float, *, particle_keys: Sequence[str],
                seed_key: str = "jet_id", seeds_per_cell: int = 16) -> DataFrame:
    """Nearest seed with distance < radius in the same event; NULL where there is none.

    Seeds are replicated to the cells around them and met by an equi join on (event, cell). With
    cells of side h every seed closer than h is met, so a nearest candidate at distance < h is
    final. Where seeds are dense the search starts with cells far smaller than the radius and only
    particles not settled there move on to cells twice as large, up to the radius itself: few
    candidates per particle without capping them. Coincident seeds collapse to the smallest key.
    """
    # Read for the density check and again at every level.
    seeds = stored(seeds.groupBy("event_id", "eta", "phi").agg(F.min(seed_key).alias("seed")), "seeds")
    cell = lambda h: (F.floor(F.col("eta") / h).alias("ce"), F.floor(F.col("phi") / h).alias("cp"))
    densest = seeds.groupBy("event_id", *cell(radius)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(0, math.ceil(math.log(max(densest / seeds_per_cell, 1), 4)))
    todo = particles.select("event_id", *particle_keys, "eta", "phi")
    settled = []
    for level in range(levels, -1, -1):
        h = radius / 2 ** level
        n_phi = max(1, math.floor(2 * math.pi / h))
        near = seeds.select("event_id", "seed", F.col("eta").alias("s_eta"), F.col("phi").alias("s_phi"),
                            F.explode(_neighbour_cells(F.col("eta"), F.col("phi"), h, n_phi)).alias("c")).select(
            "event_id", "seed", "s_eta", "s_phi", "c.ce", "c.cp")
        placed = todo.withColumn("ce", F.floor(F.col("eta") / h)).withColumn(
            "cp", F.pmod(F.floor(F.col("phi") / (F.lit(2 * math.pi) / n_phi)), F.lit(n_phi)))
        dist = delta_r(F.col("eta"), F.col("phi"), F.col("s_eta"), F.col("s_phi"))
        met = placed.join(near, ["event_id", "ce", "cp"], "left").withColumn("d", dist)
        best = met.groupBy("event_id", *particle_keys, "eta", "phi").agg(
            F.min(F.when(F.col("d") < h, F.struct("d", "seed"))).alias("b"))
        best = best.select("event_id", *particle_keys, "eta", "phi", F.col("b.seed").alias("seed"), F.col("b.d").alias("distance"))
        if level == 0:
            settled.append(best)
        else:
            ensure_checkpoint_dir(particles.sparkSession)
            best = best.checkpoint()
            settled.append(best.where(F.col("seed").isNotNull()))
            todo = best.where(F.col("seed").isNull()).select("event_id", *particle_keys, "eta", "phi")
    return concat_classes(settled).select("event_id", *particle_keys, "seed", "distance")


def hist_ratio(a: DataFrame, b: DataFrame, bins: Sequence[str], n: str = "n") -> DataFrame:
    """Bin-by-bin quotient of two binned tables, 0 where the denominator is empty."""
    left = a.select(*bins, F.col(n).alias("num"))
    right = b.select(*bins, F.col(n).alias("den"))
    j = left.join(right, list(bins), "full_outer").na.fill(0, ["num", "den"])
    return j.withColumn("ratio", F.coalesce(F.try_divide(F.col("num").cast("double"), F.nullif(F.col("den"), F.lit(0)).cast("double")), F.lit(0.0)))
