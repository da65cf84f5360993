"""The sweep: how often the forests see a row, and scores against predictions taken one by one."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from jetforge.operators import forests as M
from jetforge.operators import sampling
from jetforge.plans import sweep

COLS, KEYS = ["a", "b"], ["event_id", "jet_id"]
PARAMS = {"n_estimators": 2, "max_depth": 2, "random_state": 1}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 900, 1, 2).select(
        F.col("id").alias("event_id"), (F.col("id") * 3).alias("jet_id"), (F.col("id") % 3 + 1).cast("int").alias("label"),
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 + F.col("id") % 11 / 5).alias("b"))


def test_forests_see_every_row_once(rows, monkeypatch):
    seen, votes, fitted, fit = [], M.with_votes, [], M.batch_forests

    def noted(models, df, cols, name="votes"):
        seen.append(len(models))
        return votes(models, df, cols, name)

    def kept(df, *a, **kw):
        fitted.append((fit(df, *a, **kw), df))
        return fitted[-1][0]

    monkeypatch.setattr(M, "with_votes", noted)
    monkeypatch.setattr(M, "batch_forests", kept)
    found = sweep.grid_point(rows, KEYS, COLS, PARAMS, 2)
    assert seen == [2]
    (models, train), = fitted
    for i, m in enumerate(models):
        expected = M.predict(m, train, COLS).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
        (got,) = [r[5] for r in found if r[:4] == (i, "train", None, "accuracy")]
        assert got == pytest.approx(expected)
    assert {r[0] for r in found if r[3] == "accuracy"} == {0, 1, sweep.SURROGATE}


def test_rows_and_classes_of_all_batches_are_counted_at_once(rows, monkeypatch):
    labels, fit = [], RandomForestClassifier.fit

    def noted(self, data, *a):
        labels.append(data.schema["label"].metadata.get("ml_attr", {}).get("num_vals"))
        return fit(self, data, *a)

    monkeypatch.setattr(RandomForestClassifier, "fit", noted)
    two = rows.where("NOT (label = 3 AND event_id % 2 = 1)").withColumn("batch_id", (F.col("event_id") % 2).cast("int"))
    models = M.batch_forests(two, COLS, PARAMS, 2)
    assert sorted(labels) == [3, 4]
    assert [m.numClasses for m in models] == [4, 3]  # as a fit finds by itself: the greatest label and one
