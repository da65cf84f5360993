"""The hot paths: buckets by binary search, and how often they read their rows."""

import math
import random

from pyspark.sql import functions as F

from jetforge.functions import ordering
from jetforge.operators import silhouette, stats


def test_edges_below_a_value_as_counted_one_by_one(spark):
    edges = [-math.inf, -2.5, -0.0, 1.0, 1.5, 7.0, math.inf, math.nan]
    values = [*edges, 0.0, -3.0, 1.2, 8.0, None]
    for n in range(len(edges) + 1):
        rows = spark.createDataFrame([(edges[:n], v) for v in values] + [(None, 1.0)], "e array<double>, v double")
        plain = F.expr("size(filter(e, x -> x < v))")
        got = rows.select(ordering._below("e", "v", max(n - 1, 1)).alias("a"), plain.alias("b"), "e", "v").collect()
        assert all(r.a == r.b for r in got if r.e is not None and r.v is not None)


def visited(spark, run, n=4_000, classes=(1, 2, 3)):
    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.choice(classes), rng.choice((rng.uniform(-9, 9), 2.0, None))) for _ in range(n)], "label int, x double")
    watched = rows.withColumn("x", F.udf(look, "double").asNondeterministic()("x"))
    got = sorted(map(tuple, run(watched).collect()))
    want = sorted(map(tuple, run(rows).collect()))
    assert all(a == b or math.isclose(a, b, rel_tol=1e-12) for g, w in zip(got, want, strict=True) for a, b in zip(g, w) if not isinstance(a, str))
    return seen.value / n


def test_values_are_merged_once(spark):
    small = lambda df: silhouette.silhouette_1d_mean(df, ["x"], rows_per_task=300)
    assert visited(spark, small) <= 2


def test_distinct_values_of_quantiles_are_counted_once(spark, monkeypatch):
    looks, real = [], ordering.hot_groups
    monkeypatch.setattr(ordering, "hot_groups", lambda df, groups, rows_per_task, sizes=None: looks.append(sizes is not None) or real(df, groups, rows_per_task, sizes))
    rows = spark.range(3_000).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 1_301).cast("double").alias("v"))
    got = ordering.grouped_quantiles(rows, ["g"], "v", {"q": 0.25, "m": 0.5}, rows_per_task=200).first()
    assert looks == [False, True]
    assert (got.q, got.m) == tuple(rows.agg(F.percentile("v", F.lit(0.25)), F.percentile("v", F.lit(0.5))).first())
