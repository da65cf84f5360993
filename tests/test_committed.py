"""Appends that may be repeated, models that come back, chunks that arrive in pieces, exact cuts."""

import random

import pytest
from pyspark.sql import functions as F

from jetforge.operators import forests, votes
from jetforge.sources import committed
from jetforge.streaming import jobs


def test_append_fail_append_again(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    read = lambda: sorted((r.run, r.id, r.x) for r in committed.read_committed(spark, path, "id long, x long").collect())
    assert read() == []
    assert committed.append_once(rows, path, "a")

    def broken(batches):
        yield from batches
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        committed.append_once(rows.mapInArrow(broken, rows.schema), path, "b")
    rows.limit(7).write.mode("append").parquet(f"{path}/run=b")  # files of an attempt without a marker
    once = [("a", i, 2 * i) for i in range(100)]
    assert read() == once
    assert committed.append_once(rows, path, "b") and not committed.append_once(rows, path, "b")
    assert read() == sorted(once + [("b", i, 2 * i) for i in range(100)])
    assert committed.committed_runs(spark, path) == ["a", "b"]
    with pytest.raises(ValueError):
        committed.append_once(rows, path, "../b")


def test_models_come_back(spark, tmp_path):
    path, rng = str(tmp_path / "models"), random.Random(1)
    rows = spark.createDataFrame([(rng.random(), rng.random(), rng.randint(1, 3)) for _ in range(300)], "a double, b double, label int")
    fitted = {"R0.4pt20": forests.fit_tree(rows, ["a", "b"], 4), "R0.4pt30": forests.fit_forest(rows, ["a", "b"], {"n_estimators": 4, "max_depth": 3})}
    for point, model in fitted.items():
        assert committed.save_model(spark, path, point, model, {"max_depth": 4}, {"accuracy": 0.5})
        assert not committed.save_model(spark, path, point, model, {}, {})
    assert sorted((r.point, r.accuracy) for r in committed.scores_table(spark, path, ["accuracy"]).collect()) == [("R0.4pt20", 0.5), ("R0.4pt30", 0.5)]
    for point, model in fitted.items():
        back = committed.load_model(spark, path, point)
        same = lambda m: [r.pred for r in forests.predict(m, rows, ["a", "b"]).collect()]
        assert same(back) == same(model)
    with pytest.raises(KeyError):
        committed.load_model(spark, path, "none")


def test_a_chunk_in_five_files_gives_one_result(spark, tmp_path):
    source, places = str(tmp_path / "in"), {k: str(tmp_path / k) for k in ("staging", "out")}
    rows = spark.range(1000).select((F.col("id") % 3).cast("int").alias("chunk"), "id")
    for k in range(5):
        rows.where(F.col("id") % 5 == k).coalesce(1).write.mode("append").parquet(source)
    # Chunk 2 is announced larger than what arrives; chunk 7 never comes.
    manifest = spark.createDataFrame([(0, 334), (1, 333), (2, 400), (7, 1)], "chunk int, rows long")
    fitted = []

    def fit(chunk):
        fitted.append(chunk.select("chunk").distinct().collect()[0][0])
        return chunk.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("id").alias("total"))

    run = lambda state: sorted(tuple(r) for r in jobs.per_complete_chunk(
        jobs.file_stream(spark, source, rows.schema), manifest, fit, "chunk int, n long, total long", "t", state=str(tmp_path / state), **places).collect())
    want = [(k, len(range(k, 1000, 3)), sum(range(k, 1000, 3))) for k in (0, 1)]
    assert run("one") == want and sorted(fitted) == [0, 1]
    # A replay from the start, without the stream's memory of what it has seen.
    assert run("two") == want and sorted(fitted) == [0, 1]


def test_a_chunk_is_staged_in_one_file_a_batch(spark, tmp_path):
    source, staging = str(tmp_path / "in"), tmp_path / "staging"
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("chunk"), "id")
    rows.repartition(8, "id").write.option("maxRecordsPerFile", 20).parquet(source)
    manifest = spark.createDataFrame([(0, 200), (1, 200)], "chunk int, rows long")
    found = jobs.per_complete_chunk(jobs.file_stream(spark, source, rows.schema, files_per_trigger=10), manifest,
                                    lambda c: c.groupBy("chunk").agg(F.sum("id").alias("total")), "chunk int, total long", "t", staging=str(staging))
    assert sorted(tuple(r) for r in found.collect()) == [(0, sum(range(0, 400, 2))), (1, sum(range(1, 400, 2)))]
    folders = list(staging.glob("epoch=*/chunk=*"))
    assert len({f.parent for f in folders}) > 1 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)


def by_hand(rows, cols):
    """Best cut over all values: (gain, feature, threshold, counts below)."""
    gini = lambda c: 1 - sum((n / sum(c)) ** 2 for n in c)
    best = None
    for f, name in sorted(enumerate(cols), key=lambda x: x[1]):
        some = sorted((r[f], r[-1]) for r in rows if r[f] is not None and r[f] == r[f] and r[-1] in (1, 2, 3))
        total = [sum(k == c for _, k in some) for c in (1, 2, 3)]
        for v, nxt in zip(*(lambda u: (u, u[1:]))(sorted({v for v, _ in some}))):
            left = [sum(k == c for x, k in some if x <= v) for c in (1, 2, 3)]
            right = [t - n for t, n in zip(total, left)]
            gain = round(gini(total) - sum(left) / sum(total) * gini(left) - sum(right) / sum(total) * gini(right), 9)
            if best is None or gain > best[0]:
                best = (gain, name, (v + nxt) / 2, left)
    return best


@pytest.mark.parametrize("limit", [500_000, 10])
def test_exact_cut(spark, limit):
    rng = random.Random(2)
    rows = [(rng.choice([None, float("nan"), rng.random(), 0.25]), rng.randint(0, 9) / 3, rng.gauss(k or 0, 1), k) for k in (rng.choice([1, 2, 3, 9, None]) for _ in range(200))]
    df = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "a double, b double, c double, label int, g int")
    got = votes.exact_stump(df, ["a", "b", "c"], rows_per_task=limit).first()
    assert (got.gain, got.feature, got.threshold, [got.l1, got.l2, got.l3]) == by_hand(rows, "abc")
    for r in votes.exact_stump(df, ["a", "b", "c"], groups=["g"], rows_per_task=limit).collect():
        assert (r.gain, r.feature, r.threshold, [r.l1, r.l2, r.l3]) == by_hand(rows[r.g::2], "abc")
    assert votes.exact_stump(df.limit(0), ["a", "b"]).count() == 0
    assert votes.exact_stump(df.withColumn("a", F.lit(1.0)), ["a"]).count() == 0
