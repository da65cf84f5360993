"""The jet feature table, from constituents to labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import pt_label
from ..operators import background as bg
from ..operators import jets as J
from ..schema import FEATURES, KEYS
from ..session import rows_stay, stored
from ..sources import views


def feature_table(constits: DataFrame, sizes: DataFrame | None = None, probe: DataFrame | None = None) -> DataFrame:
    jets = J.jet_features(constits, probe=probe).withColumn("area", (10 + F.col("jet_id") % 50).cast("double") / 100)
    full = bg.pt_corr(bg.epsilon(bg.with_rho_drop2(jets, sizes=sizes)))
    return full.withColumn("label", pt_label(F.col("tru_sum"), F.col("pt_hard_min"))).drop("rho")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(views.constituents(spark, sf_dir, by_jet=True), views.event_sizes(spark, sf_dir), views.jet_sizes(spark, sf_dir))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled jets with at least one real track: every feature is defined."""
    return features(spark, sf_dir).where(F.col("n_trk") > 0)


def stored_rows(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """Training rows for jobs that read them more than once: the needed columns are written to the
    shared folder once, so later passes are column scans instead of repeated shuffles of the
    constituents, and losing an executor loses nothing."""
    cols = dict.fromkeys([*KEYS, "r_idx", "pt_hard_min", "label", *FEATURES, *columns])
    rows = training_rows(spark, sf_dir).select(*cols)
    with rows_stay(spark):
        return stored(rows, "training-rows")
