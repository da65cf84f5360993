"""Typing, labels, splits and balancing."""

import math

import pytest
from pyspark.sql import functions as F

from jetforge.functions.binning import cut_right_closed, density_bin, fixed_bin, label_names, purity_class
from jetforge.functions.kinematics import delta_phi, kinematics
from jetforge.operators import prep, sampling
from jetforge.plans.features import training_rows
from jetforge.schema import CSV_COLUMNS, SNAKE
from jetforge.sources import jet_csv


def test_label_edges_are_right_closed(spark):
    df = spark.createDataFrame([(-1.0,), (-0.5,), (1e-9,), (2e-9,), (1e7,), (2e7,)], "x double")
    got = [r[0] for r in df.select(cut_right_closed(F.col("x"), [-1, 1e-9, 1e7], [1, 2])).collect()]
    assert got == [None, 1, 1, 2, 2, None]
    with pytest.raises(Exception, match="outside label bins"):
        df.select(cut_right_closed(F.col("x"), [-1, 1e-9, 1e7], [1, 2], strict=True)).collect()


def test_names_purity_and_bins(spark):
    row = spark.range(1).select(
        label_names(F.lit(3)).alias("real"), label_names(F.lit(9)).alias("none"),
        purity_class(F.lit(0.1)).alias("p1"), purity_class(F.lit(0.9)).alias("p3"),
        fixed_bin(F.lit(0.0), 0, 1, 10).alias("first"), fixed_bin(F.lit(1.0), 0, 1, 10).alias("over"),
        fixed_bin(F.lit(-0.1), 0, 1, 10).alias("under"),
        density_bin(F.lit(1.0), F.lit(0.0), F.lit(1.0), 10).alias("closed"),
        density_bin(F.lit(2.0), F.lit(2.0), F.lit(2.0), 10).alias("flat")).first()
    assert row.asDict() == {"real": "Real", "none": None, "p1": 1, "p3": 3, "first": 1, "over": 11, "under": 0, "closed": 9, "flat": 0}


def test_angles(spark):
    k = kinematics(F.lit(0.0), F.lit(0.0), F.lit(3.0))
    row = spark.range(1).select(delta_phi(F.lit(0.1), F.lit(2 * math.pi - 0.1)).alias("d"), k["eta"].alias("eta")).first()
    assert row["d"] == pytest.approx(0.2) and row["eta"] is None


def test_minmax_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (1, 5.0, 4.0), (2, 1.0, 9.0)], "g int, a double, b double")
    assert [(r.a, r.b) for r in prep.minmax_scale(df.where("g = 1"), ["a", "b"]).orderBy("b").collect()] == [(0.0, 0.0), (0.0, 1.0)]
    assert {(r.g, r.b) for r in prep.minmax_scale(df, ["a", "b"], ["g"]).collect()} == {(1, 0.0), (1, 1.0), (2, 0.0)}


def test_csv_headers_and_types(spark, tmp_path):
    header = ", ".join(CSV_COLUMNS)
    row = ", ".join(str(i) for i in range(1, 25))
    (tmp_path / "part.csv").write_text("\n".join([header, row, header.replace(", ", ","), row, row]) + "\n")
    jets = jet_csv.read_jets(spark, str(tmp_path))
    assert jets.count() == 3
    kinds = dict(jets.dtypes)
    assert kinds["n_trk"] == "bigint" and all(t == "double" for c, t in kinds.items() if c != "n_trk")
    assert jets.columns == [SNAKE[c] for c in CSV_COLUMNS]
    r = jets.first()
    assert r["p_t"] == 1.0 and r["n_trk"] == 7 and r["z_subjet"] == 24.0


def test_older_layouts_are_stated_not_guessed(spark, tmp_path):
    (tmp_path / "old.csv").write_text(", ".join(str(i) for i in range(1, 24)) + "\n")
    r = jet_csv.read_jets(spark, str(tmp_path), CSV_COLUMNS[:-1]).first()
    assert r["p_t"] == 1.0 and r["y_bkgd"] == 23.0 and "z_subjet" not in r.asDict()


@pytest.fixture(scope="module")
def rows(spark, sf):
    df = training_rows(spark, sf).persist()
    yield df
    df.unpersist()


def test_derived_momentum_and_labels(rows):
    d = prep.signal_momentum(rows)
    assert d.where("pythia_mom < 0").count() == 0
    assert {r[0] for r in rows.select("label").distinct().collect()} == {1, 2, 3}


def test_drop_and_split_columns(rows):
    lean = prep.drop_features(rows)
    assert len(lean.columns) < len(rows.columns)
    full = prep.signal_momentum(rows).withColumn("label_name", label_names(F.col("label")))
    x = prep.feature_label_split(full)
    assert not {"x_tru", "label_name", "pythia_mom", "tru_sum"} & set(x.columns) and "label" in x.columns
    assert "pythia_mom" in prep.feature_label_split(full, keep_leaky=True).columns


def test_balancing_gives_equal_counts(rows):
    bal = sampling.balance_classes(rows, ["jet_id"])
    counts = {r["label"]: r["count"] for r in bal.groupBy("label").count().collect()}
    assert len(counts) == 3 and len(set(counts.values())) == 1
    assert bal.groupBy("jet_id", "copy").count().where("count > 1").count() == 0
    assert bal.select("jet_id", "label").distinct().join(rows.select("jet_id", "label"), ["jet_id", "label"], "left_anti").count() == 0


def test_balancing_from_one_row(spark):
    df = spark.createDataFrame([(i, 3) for i in range(2500)] + [(9001, 1), (9002, 2), (9003, 2)], "id long, label int")
    bal = sampling.balance_classes(df, ["id"])
    counts = {r["label"]: r["count"] for r in bal.groupBy("label").count().collect()}
    assert counts == {1: 2500, 2: 2500, 3: 2500}
    assert bal.where("label = 1").select("copy").distinct().count() == 2500


def test_empty_anchor_is_an_error(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "id long, label int")
    with pytest.raises(ValueError, match="anchor"):
        sampling.balance_classes(df, ["id"])


@pytest.mark.parametrize("n", [1, 10, 101])
def test_exact_split_size(spark, n):
    df = spark.range(n)
    s = sampling.train_test_split(df, ["id"])
    assert s.where("split = 'test'").count() == math.ceil(0.2 * n) and s.count() == n
    again = sampling.train_test_split(df.repartition(3), ["id"])
    assert s.exceptAll(again).count() == 0


def test_folds_are_stratified(rows):
    f = sampling.k_fold(rows.select("jet_id", "label"), ["jet_id"])
    per = f.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("k"))
    assert all(r["d"] <= 1 and r["k"] == 5 for r in per.collect())
