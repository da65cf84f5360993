"""Jet and event features: edge rows, invariants, and the path for oversized events."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetforge.operators import background as bg
from jetforge.operators import jets as J
from jetforge.operators import joins
from jetforge.sources import views as V

SCHEMA = "event_id long, jet_id long, k1 int, k2 long, k3 long, pt double, eta double, phi double, user_index int, origin_kf int"


def constit(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def jet(event, jet_id, pts, index=0, kf=0):
    return [(event, jet_id, i, 0, 0, float(p), 0.1 * i, 0.2 * i, index, kf) for i, p in enumerate(pts)]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6])
def test_leading_fills_missing_with_null(spark, n):
    r = J.leading(constit(spark, jet(1, 1, range(1, n + 1)))).first()
    want = sorted(range(1, n + 1), reverse=True)[:5] + [None] * max(0, 5 - n)
    assert [r[f"p_t_{i}"] for i in range(1, 6)] == want


def test_ghost_jet_and_jet_without_signal(spark):
    c = constit(spark, jet(1, 1, [0, 0]) + jet(1, 2, [3, 4]))
    tracks = {r["jet_id"]: r["n_trk"] for r in J.track_counts(c).collect()}
    assert tracks == {1: 0, 2: 2}
    assert {r["jet_id"]: r["first_signal"] for r in J.first_signal(c).collect()} == {1: 0, 2: 0}
    assert {r["z_subjet"] for r in J.subjet_share(c).collect()} == {-1.0}
    assert [r["jet_id"] for r in J.leading(c).collect()] == [2]
    feats = {r["jet_id"]: r for r in J.jet_features(c, carry=()).collect()}
    assert feats[1]["angularity"] is None and feats[1]["p_t"] == 0.0 and feats[2]["n_trk"] == 2


def test_population_variance_and_lesub(spark):
    c = constit(spark, jet(1, 1, [1, 2, 6]) + jet(1, 2, [4]))
    m = {r["jet_id"]: r for r in J.pt_moments(c).collect()}
    assert m[1]["var_p_t"] == pytest.approx(np.var([1, 2, 6])) and m[2]["var_p_t"] == 0
    assert [(r["jet_id"], r["lesub"]) for r in J.leading_minus_subleading(c).collect()] == [(1, 4.0)]


def test_z_sums_to_one_and_fractions_sum_to_one(spark, sf):
    c = V.constituents(spark, sf)
    z = J.fragmentation(c).groupBy("event_id", "jet_id").agg(F.sum("z").alias("z"))
    assert z.where(F.abs(F.col("z") - 1) > 1e-9).count() == 0
    y = J.origin_fractions(c).where("p_t > 0")
    assert y.where(F.abs(F.col("y_quark") + F.col("y_gluon") + F.col("y_beam") + F.col("y_bkgd") - 1) > 1e-9).count() == 0
    a = J.angularity(c)
    assert a.where((F.col("angularity") < 0) | (F.col("angularity") > math.hypot(1.8, math.pi))).count() == 0


def median_jets(spark, rows):
    return spark.createDataFrame(rows, "event_id long, jet_id long, p_t double, area double, n_trk long")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_drop2_on_small_events(spark, n):
    jets = median_jets(spark, [(1, i, float(i + 1), 1.0, 1) for i in range(n)])
    kept = sorted(range(1, n + 1), reverse=True)[min(2, n - 1):]
    assert bg.rho_median_drop2(jets).first()["rho"] == np.median(kept)


def test_oversized_events_give_the_same_medians(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 else i % 17, i, 0.0 if rng.random() < 0.1 else round(rng.random() * 50, 1), 0.5, 1) for i in range(900)]
    jets = median_jets(spark, rows)
    key = lambda df: {r["event_id"]: tuple(round(r[c], 9) for c in df.columns if c != "event_id") for r in df.collect()}
    assert key(bg.density_medians(jets)) == key(bg.density_medians(jets, rows_per_task=60))
    plain = {r["jet_id"]: r["rho"] for r in bg.with_rho_drop2(jets).collect()}
    split = {r["jet_id"]: r["rho"] for r in bg.with_rho_drop2(jets, rows_per_task=60).collect()}
    assert len(plain) == 900 and plain == pytest.approx(split)


def test_truth_match_takes_hardest_holder(spark):
    rows = jet(1, 1, [5.0], 3) + jet(1, 2, [9.0], 3) + jet(1, 3, [2.0], 0)
    got = {r["jet_id"]: (r["truth_jet"], r["x_match"], r["dist_match"]) for r in joins.truth_match(constit(spark, rows)).collect()}
    assert got[1][0] == 2 and got[1][1] == pytest.approx(5 / 9)
    assert got[2][:2] == (2, 1.0)
    assert got[3] == (None, 0.0, 1e6)


def test_event_zip_stops_with_the_shorter_side(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "event_id long")
    for limit in (2, 1000):
        got = sorted(tuple(r) for r in bg.event_zip(ids([9, 3, 7, 7]), ids([2, 5]), rows_per_task=limit).collect())
        assert got == [(1, 3, 2), (2, 7, 5)]


def test_event_gate_is_a_partition(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "event_id long")
    sel = spark.createDataFrame([(2,), (2,)], "event_id long")
    assert [r[0] for r in bg.event_gate(rows, sel).collect()] == [2]
    assert sorted(r[0] for r in bg.event_gate(rows, sel, keep=False).collect()) == [1, 3]


def test_a_hot_jet_stays_where_its_rows_are(spark):
    """A jet with a third of all constituents: its axis comes by broadcast, the result is the same."""
    rng = random.Random(1)
    rows = [(1, 0 if i % 3 == 0 else i % 400, i, 0, 0, rng.uniform(0.2, 9.0), rng.uniform(-0.9, 0.9), rng.uniform(0, 6.2), i % 2, 21)
            for i in range(6_000)]
    c = spark.createDataFrame(rows, SCHEMA).repartition(8)
    key = lambda df: {r["jet_id"]: (round(r["angularity"], 9), r["n_trk"], r["p_t_5"]) for r in df.collect()}
    want = key(J.jet_features(c, carry=()))
    for probe in (None, c.select("jet_id")):
        df = J.jet_features(c, carry=(), rows_per_task=500, probe=probe)
        assert key(df) == want and want[0][1] > 1_990
        assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    z = J.fragmentation(c, rows_per_task=500)
    assert z.count() == 6_000 and z.groupBy("jet_id").agg(F.sum("z").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_truth_match_with_a_hot_event(spark):
    rng = random.Random(2)
    rows = [(0 if i % 3 else i % 9, i % 700, i, 0, 0, rng.uniform(0.2, 9.0), rng.uniform(-0.9, 0.9), rng.uniform(0, 6.2), rng.randint(0, 4), 21)
            for i in range(2_000)]
    c = constit(spark, rows)
    key = lambda df: {(r["event_id"], r["jet_id"]): (r["truth_jet"], round(r["dist_match"], 9), round(r["x_match"], 9)) for r in df.collect()}
    assert key(joins.truth_match(c)) == key(joins.truth_match(c, rows_per_task=50))
