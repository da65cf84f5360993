"""Lineage, cones, boxes and histogram quotients."""

import math
import random

import pytest
from pyspark.sql import functions as F

from jetforge.operators import joins, trees


def test_lineage_chains_cycles_and_missing(spark):
    rows = [(10, 3), (20, 10), (30, 20), (40, 0), (50, 999)]
    rows += [(100 + i, 100 + i - 1) for i in range(1, 11)] + [(100, 5)]
    rows += [(201, 202), (202, 201)]
    nodes = spark.createDataFrame(rows, "id long, parent long")
    got = {r["id"]: (r["root"], r["status"]) for r in joins.lineage_root(nodes).collect()}
    assert got[10] == (3, "prompt") and got[30] == (3, "resolved")
    assert got[40] == (None, "error") and got[50] == (None, "error")
    assert got[110] == (5, "resolved")
    assert got[201] == (None, "error") and got[202] == (None, "error")
    assert len(got) == len(rows)


def test_lineage_stays_inside_groups(spark):
    nodes = spark.createDataFrame([(1, 20, 10), (1, 10, 2), (2, 20, 10), (2, 10, 4)], "ev long, id long, parent long")
    got = {(r["ev"], r["id"]): r["root"] for r in joins.lineage_root(nodes, groups=["ev"]).collect()}
    assert got == {(1, 20): 2, (1, 10): 2, (2, 20): 4, (2, 10): 4}


@pytest.mark.parametrize("per_cell", [1, 16])
def test_cones_match_brute_force(spark, per_cell):
    rng = random.Random(11)
    point = lambda: (rng.uniform(-0.9, 0.9), rng.uniform(0, 6.283))
    parts = [(e, i, *point()) for e in (1, 2) for i in range(150)] + [(1, 900, 0.0, 0.01)]
    seeds = [(e, 1000 + i, *point()) for e in (1, 2) for i in range(60 if e == 1 else 4)] + [(1, 2000, 0.0, 6.28)]
    p = spark.createDataFrame(parts, "event_id long, pid long, eta double, phi double")
    s = spark.createDataFrame(seeds, "event_id long, jet_id long, eta double, phi double")
    got = {(r["event_id"], r["pid"]): (r["seed"], r["distance"]) for r in
           joins.cone_assign(p, s, 0.4, particle_keys=["pid"], seeds_per_cell=per_cell).collect()}
    assert len(got) == len(parts)

    def dist(a, b):
        dphi = (a[3] - b[3] + math.pi) % (2 * math.pi) - math.pi
        return math.hypot(dphi, a[2] - b[2])

    for a in parts:
        d, seed = min((dist(a, b), b[1]) for b in seeds if b[0] == a[0])
        seen = got[(a[0], a[1])]
        if d < 0.4:
            assert seen[0] == seed and seen[1] == pytest.approx(d)
        else:
            assert seen == (None, None)
    assert got[(1, 900)][0] == 2000  # across the azimuth seam


def test_coincident_seeds_collapse(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 1.0)], "event_id long, pid long, eta double, phi double")
    s = spark.createDataFrame([(1, 8, 0.1, 1.0), (1, 5, 0.1, 1.0)], "event_id long, jet_id long, eta double, phi double")
    assert joins.cone_assign(p, s, 0.4, particle_keys=["pid"]).first()["seed"] == 5


# A small node table.
NODES = [(0, 1, 2, "x", 0.5, None), (1, 3, 4, "y", 2.0, None), (2, -1, -1, None, None, 3),
         (3, -1, -1, None, None, 1), (4, 5, 6, "x", 0.2, None), (5, -1, -1, None, None, 2), (6, -1, -1, None, None, 1)]


def test_rules_and_lookup(spark):
    nodes = spark.createDataFrame(NODES, "id int, left int, right int, feature string, threshold double, prediction int")
    rules = trees.tree_rules(nodes)
    boxes = {(r["leaf"], r["feature"]): (r["lo"], r["hi"]) for r in rules.collect()}
    assert boxes[(5, "x")] == (None, 0.2) and boxes[(6, "x")] == (0.2, 0.5) and boxes[(6, "y")] == (2.0, None)
    pts = spark.createDataFrame([(0.5, 2.0, 3), (0.2, 2.1, 5), (0.21, 9.0, 6), (0.51, 0.0, 2)], "x double, y double, want int")
    assert trees.box_lookup(pts, rules).where(F.col("leaf") != F.col("want")).count() == 0
    clipped = {(r["leaf"], r["feature"]): (r["lo"], r["hi"]) for r in trees.clip_rules(rules, {"x": (0, 1), "y": (-1, 4)}).collect()}
    assert clipped[(5, "x")] == (0.0, 0.2) and clipped[(6, "y")] == (2.0, 4.0)


def test_hist_ratio_zero_denominator(spark):
    a = spark.createDataFrame([(1, 4), (2, 3)], "b int, n long")
    b = spark.createDataFrame([(1, 2), (3, 5)], "b int, n long")
    assert {r["b"]: r["ratio"] for r in joins.hist_ratio(a, b, ["b"]).collect()} == {1: 2.0, 2: 0.0, 3: 0.0}


def test_species_mass(spark):
    df = spark.createDataFrame([(-211,), (2212,), (22,)], "kf int")
    assert {r["kf"]: r["mass"] for r in joins.species_mass(df).collect()} == {-211: 0.13957, 2212: 0.938272, 22: None}


def test_union_sources_tags_background(spark):
    sig = spark.createDataFrame([(1, 2.0, 4)], "event_id long, pt double, user_index int")
    bkg = spark.createDataFrame([(1, 3.0)], "event_id long, pt double")
    assert {(r["source"], r["user_index"]) for r in joins.union_sources(sig, bkg).collect()} == {("signal", 4), ("background", 0)}
