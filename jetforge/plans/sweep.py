"""The whole study over the parameter grid: balance, forests per batch, surrogate, scores, importances, cut, components."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forests as M
from ..operators import sampling, trees
from ..session import shared_path, stored

GRID = ["r_idx", "pt_hard_min"]
RESULT = "model_no int, split string, label int, metric string, name string, value double"
SURROGATE = -1  # model number of the surrogate; averages over the forests have none
ANCHOR, REAL, FAKE = 3, 3, 1


def _confusion(voted: DataFrame, surrogate, cols: Sequence[str]) -> list[tuple]:
    """(model, split, label, pred, n) of all models, the surrogate last, from one pass over rows with
    the forests' votes: models x splits x classes squared."""
    every = F.concat("votes", F.array("pred"))
    seen = M.predict(surrogate, voted, cols).select("split", "label", F.posexplode(every).alias("model", "pred"))
    return [tuple(r) for r in seen.groupBy("model", "split", "label", "pred").agg(F.count("*").alias("n")).collect()]


def _scores(conf: list[tuple], n_forests: int) -> list[tuple]:
    """Accuracy, class rates and fall rates of every forest and of the surrogate, and their averages
    over the forests."""
    out, per = [], {}

    def rate(model: int, split: str, label, metric: str, hits: int, total: int) -> None:
        if total:
            out.append((SURROGATE if model == n_forests else model, split, label, metric, None, hits / total))
            if model < n_forests:
                per.setdefault((split, label, metric), []).append(hits / total)

    for model, split in sorted({c[:2] for c in conf}):
        cells = [c[2:] for c in conf if c[:2] == (model, split)]
        rate(model, split, None, "accuracy", sum(n for y, p, n in cells if y == p), sum(n for *_, n in cells))
        for label in sorted({y for y, _, _ in cells}):
            rate(model, split, int(label), "class_rate", sum(n for y, p, n in cells if y == p == label), sum(n for y, _, n in cells if y == label))
        for metric, true, called in (("fall_out", FAKE, REAL), ("fall_in", REAL, FAKE)):
            rate(model, split, None, metric, sum(n for y, p, n in cells if (y, p) == (true, called)), sum(n for y, _, n in cells if y == true))
    return out + [(None, split, label, f"{metric}_mean", None, sum(v) / len(v)) for (split, label, metric), v in per.items()]


def _cut(rows: DataFrame, surrogate, cols: Sequence[str]) -> list[tuple]:
    """Root cut of the surrogate and the share of every class kept on either side."""
    root = trees.root_cut(surrogate, cols)
    if root is None:
        return []
    feature, threshold = root
    below = (F.col(feature) <= threshold).cast("double")
    share = rows.where("split = 'train'").groupBy("label").agg((100 * F.avg(below)).alias("below")).collect()
    sides = lambda x: (("pct_below", x), ("pct_above", 100 - x), ("threshold", threshold))
    return [(SURROGATE, "train", int(r["label"]), metric, feature, float(v)) for r in share for metric, v in sides(r["below"])]


def _importances(models: Sequence, cols: Sequence[str]) -> list[tuple]:
    """Importances of every forest, and their mean, population deviation and 75 % quantile."""
    each = np.array([m.featureImportances.toArray() for m in models])
    rows = [(i, None, None, "importance", c, float(v)) for i, values in enumerate(each) for c, v in zip(cols, values)]
    stats = (("importance_mean", each.mean(0)), ("importance_std", each.std(0)), ("importance_q75", np.quantile(each, 0.75, axis=0)))
    return rows + [(None, None, None, metric, c, float(v)) for metric, values in stats for c, v in zip(cols, values)]


def grid_point(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], params: dict, n_batches: int) -> list[tuple]:
    """Result rows of one grid point: a few hundred numbers, whatever the table.

    Classes are balanced first and rows split by jet, so that copies of a jet stay together. Without
    rows of the anchor class there is nothing to balance against and the rows are used as they are.
    """
    if rows.where(F.col("label") == ANCHOR).isEmpty():
        rows = rows.withColumn("copy", F.lit(0).cast("bigint"))
    else:
        rows = sampling.balance_classes(rows, keys, anchor=ANCHOR)
    data = stored(sampling.batches(sampling.hash_split(rows, keys), [*keys, "copy"], n_batches), "grid-point")
    counts = data.groupBy("split", "label").agg(F.count("*").alias("n")).collect()
    out = [(None, r["split"], r["label"], "rows", None, float(r["n"])) for r in counts]
    train = data.where("split = 'train'")
    models = M.batch_forests(train, cols, params, n_batches)
    if not models:
        return out
    # The forests see every row once: the surrogate's rows and the scores read what they said.
    voted = stored(M.with_votes(models, data.select("split", "label", *cols), cols), "grid-votes")
    surrogate = M.surrogate_tree(models, voted.where("split = 'train'"), cols, votes="votes")
    out += _scores(_confusion(voted, surrogate, cols), len(models)) + _importances(models, cols) + _cut(data, surrogate, cols)
    if sum(r["n"] for r in counts if r["split"] == "train") > 1:
        shares = M.pca(train, cols).select("component", "explained").distinct().collect()
        out += [(None, "train", None, "explained_variance", str(c), float(v)) for c, v in shares]
    return out


def sweep(df: DataFrame, keys: Sequence[str], cols: Sequence[str], params: dict, *, n_batches: int = 10,
          parallelism: int = 4, grid: Sequence[str] = GRID) -> DataFrame:
    """All grid points of the table into one long results table.

    MLlib fits one model at a time, so points are separate jobs; a few run side by side and share
    the cluster. The list of points is the only thing collected. Every point reads only its own
    partition of the stored rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, "sweep-rows")
    df.hint("rebalance", *grid).write.partitionBy(*grid).parquet(path)
    rows = spark.read.parquet(path)
    points = [tuple(r) for r in rows.select(*grid).distinct().collect()]

    def one(point: tuple) -> list[tuple]:
        cond = F.lit(True)
        for name, value in zip(grid, point):
            cond = cond & (F.col(name) == value)
        return [(*point, *r) for r in grid_point(rows.where(cond), keys, cols, params, n_batches)]

    pool = ThreadPool(parallelism)
    try:
        results = pool.map(inheritable_thread_target(spark)(one), points)
    finally:
        pool.close()
    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in grid)
    return stored(spark.createDataFrame([r for rs in results for r in rs], f"{kinds}, {RESULT}"), "sweep-results")
