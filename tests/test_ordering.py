"""Hot-group paths against brute force: one group holds most rows, many values tie."""

import random

import numpy as np
import pytest

from jetforge.functions import ordering as O
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        g = 0 if i % 3 else i % 40
        value = 5.0 if rng.random() < 0.35 else round(rng.gauss(0, 3), 2)
        rows.append((g, i, value))
    return rows


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed, "g int, id long, v double")


def by_group(rows):
    out = {}
    for g, i, v in rows:
        out.setdefault(g, []).append((v, i))
    return out


@pytest.mark.parametrize("limit", [50, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_rank(frame, skewed, limit, descending):
    got = {r["id"]: r["rank"] for r in O.ranked(frame, ["g"], "v", "id", descending=descending, rows_per_task=limit).collect()}
    assert len(got) == len(skewed)
    for rows in by_group(skewed).values():
        order = sorted(rows, key=lambda t: (-t[0] if descending else t[0], t[1]))
        for k, (_, i) in enumerate(order, 1):
            assert got[i] == k


@pytest.mark.parametrize("limit", [50, 10_000])
def test_rank_without_groups(frame, skewed, limit):
    got = {r["id"]: r["rank"] for r in O.ranked(frame, [], "v", "id", rows_per_task=limit).collect()}
    for k, (_, i, _) in enumerate(sorted(((v, i, g) for g, i, v in skewed)), 1):
        assert got[i] == k


@pytest.mark.parametrize("limit", [50, 10_000])
def test_lag(frame, skewed, limit):
    got = {r["id"]: r["previous"] for r in O.lagged(frame, ["g"], "v", "id", rows_per_task=limit).collect()}
    for rows in by_group(skewed).values():
        prev = None
        for v, i in sorted(rows):
            assert got[i] == prev
            prev = v


@pytest.mark.parametrize("limit", [50, 10_000])
@pytest.mark.parametrize("groups", [["g"], []])
def test_quantiles(frame, skewed, limit, groups):
    probs = {"q10": 0.1, "q50": 0.5, "q75": 0.75}
    got = O.grouped_quantiles(frame, groups, "v", probs, rows_per_task=limit).collect()
    want = {g: [v for v, _ in rows] for g, rows in by_group(skewed).items()} if groups else {None: [v for _, _, v in skewed]}
    assert len(got) == len(want)
    for r in got:
        values = want[r["g"] if groups else None]
        for n, p in probs.items():
            assert r[n] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_hot_buckets_stay_small(frame):
    """A value shared by a third of the rows is spread by the tie-break key."""
    hot = O.hot_groups(frame, ["g"], 50)
    assert hot.count == 1 and hot.largest > 900
    cut = O._add_buckets(frame, ["g"], "v", "id", hot, 50)
    assert cut.groupBy("g", O._B).count().agg(F.max("count")).first()[0] <= 150


def test_hash_rank(frame, skewed):
    got = O.hash_ranked(frame, ["g"], ["id"]).collect()
    for g, rows in by_group(skewed).items():
        mine = [r for r in got if r["g"] == g]
        assert sorted(r["rank"] for r in mine) == list(range(1, len(rows) + 1))
        assert {r["group_n"] for r in mine} == {len(rows)}


def test_top_k_limits_before_the_shuffle(frame):
    top = O.top_k(frame, ["g"], [F.col("v").desc(), F.col("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("limit", [30, 10_000])
def test_null_groups_and_values_are_kept(spark, limit):
    rows = [(None if i % 2 else 1, i, None if i % 3 == 0 else float(i % 7)) for i in range(240)]
    df = spark.createDataFrame(rows, "g int, id long, v double")
    got = {r["id"]: r["rank"] for r in O.ranked(df, ["g"], "v", "id", rows_per_task=limit).collect()}
    assert len(got) == 240
    for g in (None, 1):
        mine = sorted(((v is not None, v or 0.0, i) for gg, i, v in rows if gg == g))
        for k, (_, _, i) in enumerate(mine, 1):
            assert got[i] == k
    assert O.hash_ranked(df, ["g"], ["id"]).count() == 240
    q = {r["g"]: r["m"] for r in O.grouped_quantiles(df, ["g"], "v", {"m": 0.5}, rows_per_task=limit).collect()}
    assert set(q) == {None, 1}
    lag = O.lagged(df.where("v is not null"), ["g"], "v", "id", rows_per_task=limit)
    assert lag.count() == 160 and lag.where("previous is null").count() == 2


@pytest.mark.parametrize("limit", [5, 40, 10_000])
def test_hash_ranges_stay_below_the_limit(frame, skewed, limit, monkeypatch):
    hashed = frame.withColumn("_h", O.hash60("id", seed=42))
    bits = O.bucket_bits(hashed, limit)
    largest = hashed.groupBy(F.shiftright("_h", O.HASH_BITS - bits)).count().agg(F.max("count")).first()[0]
    assert largest <= limit and (bits == 0) == (limit >= len(skewed))
    got = {r["id"]: (r["rank"], r["group_n"]) for r in O.hash_ranked(frame, ["g"], ["id"], rows_per_task=limit).collect()}
    assert got == {r["id"]: (r["rank"], r["group_n"]) for r in O.hash_ranked(frame, ["g"], ["id"]).collect()}
    assert sorted(v[0] for k, v in got.items() if k % 3) == list(range(1, 1001)) or len({v[1] for v in got.values()}) > 1


def test_equal_hashes_do_not_loop(spark):
    assert O.bucket_bits(spark.range(100).withColumn("_h", F.lit(7).cast("bigint")), 10) == O.MAX_BUCKET_BITS


@pytest.mark.parametrize("screen", [2, 1 << 16])
def test_hot_groups_in_a_huge_table(spark, monkeypatch, screen):
    """Few screen buckets stand for a table so large that every bucket is over the limit."""
    monkeypatch.setattr(O, "SCREEN_BUCKETS", screen)
    df = spark.range(4000).select(F.when(F.col("id") < 400, 1).when(F.col("id") < 600, 2).otherwise(F.col("id")).alias("g"), "id")
    hot = O.hot_groups(df, ["g"], 100)
    assert (hot.count, hot.largest, sorted(r.g for r in hot.frame.collect())) == (2, 400, [1, 2])
    assert O.hot_groups(df.where("id >= 600"), ["g"], 100).count == 0
    ranks = {r["id"]: r["rank"] for r in O.ranked(df.withColumn("v", F.col("id") % 7), ["g"], "v", "id", rows_per_task=100).collect()}
    order = sorted(range(400), key=lambda i: (i % 7, i))
    assert [ranks[i] for i in order] == list(range(1, 401))


def test_many_hot_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(O, "MAX_BROADCAST_GROUPS", 1)
    monkeypatch.setattr(O, "MAX_SMALL_GROUPS", 1)
    df = spark.range(600).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 11).cast("double").alias("v"))
    got = O.grouped_quantiles(df, ["g"], "v", {"m": 0.5}, rows_per_task=50)
    assert {r.g: r.m for r in got.collect()} == {g: float(np.median([i % 11 for i in range(g, 600, 3)])) for g in range(3)}
    back = O.attach(df, got, ["g"], rows_per_task=50)
    assert back.count() == 600 and back.where("m is null").count() == 0
