"""Result tables over the parameter grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Display names of the forest parameters.
PARAM_NAMES = {
    "random_state": "Random State", "oob_score": "OOB Score", "n_jobs": "Number of Jobs",
    "n_estimators": "Number of Estimators", "min_weight_fraction_leaf": "Minimum Weight Fraction Leaf",
    "min_samples_split": "Minimum Samples Split", "min_samples_leaf": "Minimum Samples Leaf",
    "min_impurity_decrease": "Minimum Impurity Decrease", "max_samples": "Max Samples",
    "max_leaf_nodes": "Max Leaf Nodes", "max_features": "Max Features", "max_depth": "Max Depth",
    "criterion": "Criterion", "class_weight": "Class Weight",
}


def metric_series(metrics: DataFrame, points: Sequence, by: Sequence[str] = ("r_idx", "metric"), over: str = "pt_hard_min",
                  value: str = "value", prefix: str = "pt_") -> DataFrame:
    """One row per (R, metric), one column per threshold. ``points`` states the columns, so that the
    pivot needs no extra pass."""
    out = metrics.groupBy(*by).pivot(over, list(points)).agg(F.max(value))
    return out.select(*by, *[F.col(f"`{p}`").alias(f"{prefix}{p}") for p in points])


def params_report(params: DataFrame, grid: Sequence[str] = ("r_idx", "pt_hard_min")) -> DataFrame:
    """Display name and value of each parameter, in descending name order per grid point."""
    names = F.create_map(*[F.lit(v) for kv in PARAM_NAMES.items() for v in kv])
    w = Window.partitionBy(*grid).orderBy(F.col("name").desc())
    return params.select(*grid, F.row_number().over(w).alias("line"),
                         F.coalesce(F.try_element_at(names, F.col("name")), F.col("name")).alias("parameter"), "value")


def saved_params(params: DataFrame, grid: Sequence[str] = ("r_idx", "pt_hard_min")) -> DataFrame:
    """Long parameter table as written after a search: fixed run settings are added per grid point."""
    extra = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
                      for n, v in (("oob_score", "True"), ("random_state", "42"), ("n_jobs", "-1"))])
    fixed = params.select(*grid).distinct().select(*grid, F.explode(extra).alias("e")).select(*grid, "e.*")
    return params.select(*grid, "name", "value").unionByName(fixed)


def loaded_params(params: DataFrame, low_pt: bool = False) -> DataFrame:
    """Long parameter table as used for a run: automatic feature count; the class weight is dropped,
    or replaced for the low-pT model."""
    rows = params if low_pt else params.where(F.col("name") != "class_weight")
    value = F.when(F.col("name") == "max_features", "auto")
    if low_pt:
        value = value.when(F.col("name") == "class_weight", "{1:1,2:1,3:4}")
    return rows.withColumn("value", value.otherwise(F.col("value")))


def share_report(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Percentage of the group total. Groups hold one row per feature or class."""
    total = F.sum(value).over(Window.partitionBy(*groups))
    return df.withColumn("pct", F.try_divide(F.lit(100.0) * F.col(value), F.nullif(total, F.lit(0.0))))


def log_lines(counts: DataFrame, grid: Sequence[str] = ("r_idx", "pt_hard_min"), features: Sequence[str] = (),
              scores: dict[str, str] | None = None) -> DataFrame:
    """Text log lines (block, line, text) per grid point: class counts, the features of the run, and
    a line for every further column of ``counts`` named in ``scores`` (column to title)."""
    r, p = F.lit(0.2) + F.lit(0.1) * F.col("r_idx"), F.col("pt_hard_min")
    lines = F.array(
        F.format_string("Analyzing jets with R=%.1f and p_T hardmin=%d", r, p),
        F.format_string("Number of Fake Jets: %d", F.col("n1")),
        F.format_string("Number of Squishy Jets: %d", F.col("n2")),
        F.format_string("Number of Real Jets: %d", F.col("n3")),
        *([F.lit(f"Number of Features: {len(features)}"), F.lit(f"Features: {', '.join(features)}")] if features else []),
        *[F.format_string(f"{title}: %.4f", F.col(c)) for c, title in (scores or {}).items()])
    return counts.select(*grid, F.posexplode(lines).alias("line", "text"))


def parse_log(lines: DataFrame, block: Sequence[str] = ("r_idx", "pt_hard_min")) -> DataFrame:
    """Text log back to (block, metric, value)."""
    parsed = lines.select(*block, "line",
                          F.regexp_extract("text", r"^([^:=]+): *([-0-9.]+)$", 1).alias("metric"),
                          F.regexp_extract("text", r"^([^:=]+): *([-0-9.]+)$", 2).try_cast("double").alias("value"))
    return parsed.where(F.col("value").isNotNull()).drop("line")


def append_results(df: DataFrame, path: str) -> None:
    """Append rows to the long results table."""
    df.write.mode("append").parquet(path)
