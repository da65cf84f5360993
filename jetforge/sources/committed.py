"""Appends that may be repeated, and a store of fitted models built on them.

An append has a name (its run). Its files go to a folder of that name, which a repeated attempt
replaces; a marker written last says that the folder is whole. Readers see marked folders only, so
an attempt that failed leaves nothing behind and one that is repeated adds nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _safe(run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
        raise ValueError(f"a run is named by letters, digits, dots, dashes and underscores: {run!r}")
    return run


def is_committed(spark: SparkSession, path: str, run: str) -> bool:
    fs, marker = _fs(spark, f"{path}/{COMMITS}/{_safe(run)}")
    return fs.exists(marker)


def commit(spark: SparkSession, path: str, run: str) -> None:
    fs, marker = _fs(spark, f"{path}/{COMMITS}/{_safe(run)}")
    fs.create(marker, True).close()


def append_once(df: DataFrame, path: str, run: str, *, fmt: str = "parquet", options: dict[str, str] | None = None) -> bool:
    """Append the rows under the name of the run; False (and nothing written) if that run is already
    there. Two writers must not use one name at the same time."""
    spark = df.sparkSession
    if is_committed(spark, path, run):
        return False
    df.write.mode("overwrite").format(fmt).options(**(options or {})).save(f"{path}/run={run}")
    commit(spark, path, run)
    return True


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole runs: one file name each."""
    fs, folder = _fs(spark, f"{path}/{COMMITS}")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def read_committed(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """Rows of the whole runs, with the name as ``run``. Without any there are no rows."""
    runs = committed_runs(spark, path)
    if not runs:
        return spark.createDataFrame([], f"{schema}, run string")
    read = spark.read.schema(f"{schema}, run string").format(fmt).options(**(options or {})).option("basePath", path)
    return read.load([f"{path}/run={r}" for r in runs])


INDEX = "point string, params string, scores string, model string"


def save_model(spark: SparkSession, path: str, point: str, model, params: dict, scores: dict) -> bool:
    """Store a fitted model with its parameters and scores under the name of its grid point; False
    if that point has one. A model half written by a failed attempt is replaced."""
    if is_committed(spark, path, point):
        return False
    model.write().overwrite().save(f"{path}/models/{_safe(point)}")
    row = [(point, json.dumps(params, sort_keys=True), json.dumps(scores, sort_keys=True), f"models/{point}")]
    return append_once(spark.createDataFrame(row, INDEX), path, point)


def stored_models(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored model: point, params and scores (JSON), model (its folder in the store)."""
    return read_committed(spark, path, INDEX).drop("run")


def load_model(spark: SparkSession, path: str, point: str):
    """The model of a grid point, of the class it was saved as."""
    if not is_committed(spark, path, point):
        raise KeyError(point)
    return DefaultParamsReader.loadParamsInstance(f"{path}/models/{_safe(point)}", spark.sparkContext)


def scores_table(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Scores of the stored models as columns."""
    parsed = F.from_json("scores", ", ".join(f"{n} double" for n in names)).alias("s")
    return stored_models(spark, path).select("point", parsed).select("point", "s.*")
