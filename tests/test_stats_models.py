"""Histograms, silhouettes, votes, stump and models."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from jetforge.functions.hashing import hash60
from jetforge.operators import forests as M
from jetforge.operators import reports, sampling, silhouette, stats, trees, votes
from jetforge.streaming import jobs


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        c = rng.choice([1, 1, 1, 2, 3])
        rows.append((i, c, round(rng.gauss(c, 1.0), 1), round(rng.gauss(-c, 2.0), 1)))
    rows.append((400, 3, 0.0, 0.0))
    df = spark.createDataFrame(rows, "id long, label int, a double, b double").persist()
    yield rows, df
    df.unpersist()


def brute(rows, dims):
    x = np.array([[r[d] for d in dims] for r in rows])
    lab = np.array([r[1] for r in rows])
    dist = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = dist[i][own].sum() / (own.sum() - 1)
        b = min(dist[i][lab == o].mean() for o in set(lab) if o != lab[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


@pytest.mark.parametrize("limit", [30, 100_000])
def test_silhouette_1d(points, limit):
    rows, df = points
    want = brute(rows, [2])
    got = {(r["value"], r["label"]): r["silhouette"] for r in silhouette.silhouette_1d(df, ["a"], rows_per_task=limit).collect()}
    for r, w in zip(rows, want):
        assert got[(r[2], r[1])] == pytest.approx(w, abs=1e-9)
        assert -1 <= got[(r[2], r[1])] <= 1


@pytest.mark.parametrize("block", [37, 1000])
def test_silhouette_rows(points, block):
    rows, df = points
    vec = df.withColumn("v", F.array("a", "b"))
    got = {r["id"]: r["silhouette"] for r in silhouette.silhouette_rows(vec, "id", "v", rows_per_block=block).collect()}
    want = brute(rows, [2, 3])
    assert len(got) == len(rows)
    for r, w in zip(rows, want):
        assert got[r[0]] == pytest.approx(w, abs=1e-9)


def test_silhouette_single_row_class(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, 1.0), (3, 2, 5.0)], "id long, label int, a double")
    got = {r["id"]: r["silhouette"] for r in silhouette.silhouette_rows(df.withColumn("v", F.array("a")), "id", "v").collect()}
    assert got[3] == 0.0 and got[1] == pytest.approx(0.8)
    assert {r["silhouette"] for r in silhouette.silhouette_1d(df, ["a"], classes=(1, 2)).where("label = 2").collect()} == {0.0}


def test_squared_silhouette_equals_the_evaluator(points):
    _, df = points
    ours = silhouette.silhouette_squared(df, ["a", "b"]).agg(F.avg("silhouette")).first()[0]
    scorer = ClusteringEvaluator(predictionCol="label", featuresCol="features")
    assert ours == pytest.approx(scorer.evaluate(M.assemble(df, ["a", "b"])), abs=1e-6)


def test_fixed_histogram_keeps_every_row(points):
    rows, df = points
    h = stats.fixed_histogram(df, F.col("a"), 0, 3, 6, weight=F.col("b"))
    assert h.agg(F.sum("n")).first()[0] == len(rows)
    assert h.agg(F.sum("sumw2")).first()[0] == pytest.approx(sum(r[3] ** 2 for r in rows))
    n = stats.normalize_histogram(stats.fixed_histogram(df, F.col("a"), 0, 3, 6), 0.5)
    inside = n.where("bin between 1 and 6").agg(F.sum(F.col("density") * 0.5)).first()[0]
    assert inside == pytest.approx(sum(0 <= r[2] < 3 for r in rows) / len(rows))


def test_density_histogram_integrates_to_one(points):
    rows, df = points
    h = stats.density_histogram(df, ["a", "b"], 10).collect()
    for c in ("a", "b"):
        for g in (0, 1, 2, 3):
            mine = [r for r in h if r["feature"] == c and r["grp"] == g]
            vals = [r[2 if c == "a" else 3] for r in rows if g in (0, r[1])]
            counts, edges = np.histogram(vals, bins=10, density=False)
            assert len(mine) == 10 and sum(r["n"] for r in mine) == len(vals)
            width = edges[1] - edges[0]
            assert sum(r["density"] for r in mine) * width == pytest.approx(1.0)


@pytest.mark.parametrize("limit", [50, 100_000])
def test_describe(points, limit):
    rows, df = points
    d = {r["feature"]: r for r in stats.describe(df, ["a", "b"], rows_per_task=limit).collect()}
    a = np.array([r[2] for r in rows])
    assert d["a"]["q25"] == pytest.approx(np.quantile(a, 0.25)) and d["a"]["std"] == pytest.approx(a.std(ddof=1))


def test_corr_wide_and_long_agree(points, monkeypatch):
    _, df = points
    key = lambda rows: {(r["a"], r["b"]): round(r["corr"], 9) for r in rows}
    wide = key(stats.corr_matrix(df, ["a", "b", "id"]).collect())
    monkeypatch.setattr(stats, "MAX_WIDE_PAIRS", 1)
    assert len(wide) == 9 and wide == key(stats.corr_matrix(df, ["a", "b", "id"]).collect())
    assert wide[("a", "b")] == wide[("b", "a")] and wide[("a", "a")] == 1.0


def test_profile_strict_edges_lose_rows(points):
    rows, df = points
    loose = stats.profile(df, "a", "b", 20).agg(F.sum("n")).first()[0]
    strict = stats.profile(df, "a", "b", 20, strict_edges=True).agg(F.sum("n")).first()[0]
    assert loose == len(rows) and strict < loose


def test_majority_vote_ties_to_smallest(spark):
    v = spark.createDataFrame([(1, 3), (1, 2), (1, 1), (2, 3), (2, 3), (2, 1)], "id long, pred int")
    assert {r["id"]: (r["vote"], r["n_votes"]) for r in votes.majority_vote(v, ["id"]).collect()} == {1: (1, 1), 2: (3, 2)}


def test_stump_matches_brute_force(points):
    rows, df = points
    n_bins = 12
    best = votes.best_stump(votes.stump_counts(df, ["a", "b"], n_bins), n_bins).first()

    def gini(labels):
        return 1 - sum((labels.count(c) / len(labels)) ** 2 for c in (1, 2, 3)) if labels else 0

    cand = []
    for name, d in (("a", 2), ("b", 3)):
        lo, hi = min(r[d] for r in rows), max(r[d] for r in rows)
        for b in range(n_bins - 1):
            t = lo + (hi - lo) / n_bins * (b + 1)
            left, right = [r[1] for r in rows if r[d] <= t], [r[1] for r in rows if r[d] > t]
            if left and right:
                n = len(rows)
                cand.append((gini([r[1] for r in rows]) - len(left) / n * gini(left) - len(right) / n * gini(right), name, t))
    gain, name, t = max(cand, key=lambda c: (round(c[0], 9), c[1] == "a"))
    assert best["feature"] == name and best["gain"] == pytest.approx(gain, abs=1e-8) and best["threshold"] == pytest.approx(t)
    text = votes.cut_report(votes.best_stump(votes.stump_counts(df, ["a", "b"], n_bins), n_bins), {1: "Fake", 3: "Real"}).collect()
    assert all(abs(r["pct_below"] + r["pct_above"] - 100) < 1e-9 for r in text) and "keeps" in text[0]["below_text"]


def test_metric_mean_and_rates(spark):
    m = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "metric string, value double")
    assert stats.metric_mean(m, ["metric"]).first()["mean"] == 1.5
    assert stats.metric_mean(m, ["metric"], compat=True).first()["mean"] == 1.0
    p = spark.createDataFrame([(1, 3), (1, 1), (3, 3), (3, 1)], "label int, pred int")
    assert tuple(stats.fall_rates(p).first()) == (0.5, 0.5)


@pytest.mark.parametrize("limit", [20, 100_000])
def test_intervals(spark, limit):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("u"), F.timestamp_seconds(F.col("id") * F.col("id")).alias("ts"))
    gaps = stats.interval_gaps(df, "ts", "id", ["u"], rows_per_task=limit)
    s, h = stats.interval_stats(gaps, ["u"]), stats.interval_histogram(gaps)
    got = {r["u"]: (r["n"], r["total"]) for r in s.collect()}
    assert got == {0: (99, 198.0 ** 2), 1: (99, 199.0 ** 2 - 1)}
    assert h.agg(F.sum("n")).first()[0] == 198


@pytest.fixture(scope="module")
def labelled(points):
    _, df = points
    return sampling.hash_split(df, ["id"])


PARAMS = {"n_estimators": 5, "max_depth": 3, "criterion": "entropy", "max_features": "auto", "random_state": 42}


def test_forest_vote_surrogate_and_rules(spark, labelled):
    cols = ["a", "b"]
    models = M.batch_forests(sampling.batches(labelled, ["id"], 2), cols, PARAMS, 4)
    assert len(models) == 2
    v = M.ensemble_votes(models, labelled, ["id"], cols)
    assert v.count() == labelled.count() * 2
    tree = M.surrogate_tree(models, labelled, cols)
    nodes = trees.model_nodes(tree, cols)
    rules = trees.tree_rules(nodes)
    pred = {r["id"]: r["prediction"] for r in nodes.where("left < 0").collect()}
    looked = trees.box_lookup(M.predict(tree, labelled, cols), rules).collect()
    assert all(pred[r["leaf"]] == r["pred"] for r in looked)
    imp = M.tree_importances(models[0], cols, spark)
    total = votes.importance_stats(imp).agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0, abs=1e-6)


def test_search_covers_every_candidate(labelled):
    grid = {"max_depth": [1, 2], "class_weight": [{1: 1, 2: 1, 3: 10}], "min_samples_split": [2]}
    with pytest.warns(UserWarning, match="min_samples_split"):
        best, scores = M.coordinate_search(labelled, ["a", "b"], grid=grid, base={"n_estimators": 2, "random_state": 1}, folds=2, keys=["id"])
    assert len(scores) == 3 and all(0 <= s[2] <= 1 for s in scores)
    assert set(best) == {"max_depth", "class_weight"}
    assert sum(len(v) for v in M.SEARCH_GRID.values()) == 38


def test_param_store():
    saved = M.saved_params({"max_features": 1, "class_weight": {3: 10}})
    assert saved["oob_score"] and saved["random_state"] == 42
    assert M.stored_params(saved)["max_features"] == "auto" and "class_weight" not in M.stored_params(saved)
    assert M.stored_params(saved, low_pt=True)["class_weight"] == {1: 1, 2: 1, 3: 4}


def test_pca_against_numpy(points):
    rows, df = points
    got = M.pca(df, ["a", "b"]).collect()
    x = np.array([[r[2], r[3]] for r in rows])
    w = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    shares = sorted({(r["component"], r["explained"]) for r in got})
    assert [s for _, s in shares] == pytest.approx(list(w / w.sum()))
    for k in (1, 2):
        assert sum(r["loading"] ** 2 for r in got if r["component"] == k) == pytest.approx(1.0)


def test_micro_batch_models(spark, points, tmp_path):
    """One forest per arriving file, each reporting its accuracy on the next data seen."""
    _, df = points
    path = str(tmp_path / "chunks")
    df.repartition(3).write.parquet(path)

    def fit(batch, epoch):
        model = M.fit_forest(batch, ["a", "b"], PARAMS)
        return stats.accuracy(M.predict(model, batch, ["a", "b"])).withColumn("n", F.lit(batch.count()))

    out = jobs.micro_batches(jobs.file_stream(spark, path, df.schema), fit, "models").collect()
    assert len(out) == 3 and sum(r["n"] for r in out) == df.count()
    assert all(r["accuracy"] > 0.5 for r in out)


def test_stream_histogram_equals_batch(spark, points, tmp_path):
    _, df = points
    path = str(tmp_path / "events")
    df.repartition(4).write.parquet(path)
    stream = jobs.file_stream(spark, path, df.schema)
    live = jobs.run_complete(jobs.stream_histogram(stream, F.col("a"), 0, 4, 8, ["label"]), "h")
    batch = stats.fixed_histogram(df, F.col("a"), 0, 4, 8, ["label"]).select("label", "bin", "n")
    assert live.select("label", "bin", "n").exceptAll(batch).count() == 0 and live.count() == batch.count()


def test_log_round_trip(spark):
    counts = spark.createDataFrame([(0, 20, 5, 6, 7)], "r_idx int, pt_hard_min int, n1 long, n2 long, n3 long")
    lines = reports.log_lines(counts)
    assert lines.where("line = 0").first()["text"] == "Analyzing jets with R=0.2 and p_T hardmin=20"
    assert {r["metric"]: r["value"] for r in reports.parse_log(lines).collect()} == {
        "Number of Fake Jets": 5.0, "Number of Squishy Jets": 6.0, "Number of Real Jets": 7.0}


def test_hash_is_portable(spark):
    assert spark.range(1).select(hash60(F.lit(7), seed=42)).first()[0] == 378345120718761312


def test_sweep_covers_the_grid(spark, points):
    from jetforge.plans.sweep import sweep

    _, df = points
    rows = df.where("id < 400").withColumn("r_idx", (F.col("id") % 2).cast("int")).withColumn("pt_hard_min", F.lit(20))
    res = sweep(rows, ["id"], ["a", "b"], PARAMS, n_batches=2, parallelism=2).persist()
    assert {tuple(r) for r in res.select("r_idx", "pt_hard_min").distinct().collect()} == {(0, 20), (1, 20)}
    assert {r[0] for r in res.select("metric").distinct().collect()} >= {
        "rows", "accuracy", "class_rate", "fall_out", "fall_in", "accuracy_mean", "fall_out_mean", "importance", "importance_mean", "importance_std",
        "importance_q75", "explained_variance"}
    assert res.where("metric = 'accuracy'").count() == 2 * 2 * 3
    assert res.where("metric = 'accuracy' and (value < 0 or value > 1)").count() == 0
    both = res.where("metric in ('pct_below', 'pct_above')").groupBy("r_idx", "label").agg(F.sum("value").alias("s"))
    assert all(abs(r["s"] - 100) < 1e-9 for r in both.collect())
