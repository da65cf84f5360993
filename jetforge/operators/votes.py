"""Ensemble votes, importances and the single-cut stump."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import ROWS_PER_TASK, grouped_quantiles, join_small, running
from ..session import stored
from .stats import melt


def majority_vote(votes: DataFrame, row: Sequence[str], pred: str = "pred") -> DataFrame:
    """Most frequent prediction per row, ties to the smallest class."""
    counts = votes.groupBy(*row, pred).agg(F.count("*").alias("n"))
    return counts.groupBy(*row).agg(
        F.max(F.struct("n", (-F.col(pred)).alias("neg"))).alias("t")).select(
        *row, (-F.col("t.neg")).alias("vote"), F.col("t.n").alias("n_votes"))


def importance_rank(df: DataFrame, groups: Sequence[str], importance: str = "importance", feature: str = "feature") -> DataFrame:
    """1-based rank by descending importance. Groups hold one row per feature."""
    w = Window.partitionBy(*groups).orderBy(F.col(importance).desc(), feature)
    return df.withColumn("rank", F.row_number().over(w))


def importance_stats(trees: DataFrame, groups: Sequence[str] = (), value: str = "importance") -> DataFrame:
    """Mean, population deviation and 75 % quantile over the trees of each feature."""
    by = [*groups, "feature"]
    basic = trees.groupBy(*by).agg(F.avg(value).alias("importance"), F.stddev_pop(value).alias("std"))
    return basic.join(grouped_quantiles(trees, by, value, {"q75": 0.75}), by)


def stump_counts(df: DataFrame, cols: Sequence[str], n_bins: int, label: str = "label",
                 groups: Sequence[str] = ()) -> DataFrame:
    """Row counts per (group, feature, bin, class); bins tile each feature's range inside the group
    and candidate cuts are the upper bin edges. All features and groups share one pass. A row
    without a value (NULL or NaN) of a feature is not counted for that feature."""
    df = df.select(*groups, label, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    bounds = df.groupBy(*groups).agg(*[
        f(c).cast("double").alias(f"_{p}_{c}") for c in cols for f, p in ((F.min, "lo"), (F.max, "hi"))])
    rows = df.select(*groups, label, *cols)
    if groups:
        rows = join_small(rows, bounds, groups)
    else:
        row = bounds.first()
        rows = rows.select("*", *[F.lit(row[c]).alias(c) for c in bounds.columns])
    cells = []
    for c in cols:
        x, lo, hi = F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        # Right-closed bins, so that "value <= upper edge" is exactly "bin <= b".
        b = F.when(x <= lo, 0).otherwise(F.greatest(F.ceil(F.try_divide((x - lo) * n_bins, hi - lo)) - 1, F.lit(0)))
        cells.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("feature"), F.least(b, F.lit(n_bins - 1)).cast("int").alias("bin"),
                                                    lo.alias("lo"), hi.alias("hi"))))
    long = rows.select(*groups, label, F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return long.groupBy(*groups, "c.feature", "c.bin", "c.lo", "c.hi", label).agg(F.count("*").alias("n"))


def best_stump(counts: DataFrame, n_bins: int, classes: Sequence[int] = (1, 2, 3), label: str = "label",
               groups: Sequence[str] = ()) -> DataFrame:
    """The (feature, edge) with the largest Gini gain per group, with class counts on both sides.

    Works on the binned counts only: groups x features x bins x classes rows.
    """
    per_bin = counts.groupBy(*groups, "feature", "bin", "lo", "hi").agg(
        *[F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in classes])
    upto = Window.partitionBy(*groups, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups, "feature")
    left = per_bin.select(*groups, "feature", "bin", "lo", "hi",
                          *[F.sum(f"n{c}").over(upto).alias(f"l{c}") for c in classes],
                          *[F.sum(f"n{c}").over(whole).alias(f"t{c}") for c in classes])
    add = lambda prefix: sum((F.col(f"{prefix}{c}") for c in classes[1:]), F.col(f"{prefix}{classes[0]}"))
    l_tot, t_tot = add("l"), add("t")
    r_tot = t_tot - l_tot
    impurity = lambda parts, total: F.lit(1.0) - sum((p / total) * (p / total) for p in parts)
    g_t = impurity([F.col(f"t{c}") for c in classes], t_tot)
    g_l = impurity([F.col(f"l{c}") for c in classes], l_tot)
    g_r = impurity([F.col(f"t{c}") - F.col(f"l{c}") for c in classes], r_tot)
    gain = g_t - l_tot / t_tot * g_l - r_tot / t_tot * g_r
    scored = left.where((l_tot > 0) & (r_tot > 0)).withColumn("gain", F.round(gain, 9)).withColumn(
        "threshold", F.col("lo") + (F.col("hi") - F.col("lo")) / n_bins * (F.col("bin") + 1))
    best = Window.partitionBy(*groups).orderBy(F.col("gain").desc(), "feature", "bin")
    return scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r", "lo", "hi", "bin")


def exact_stump(df: DataFrame, cols: Sequence[str], classes: Sequence[int] = (1, 2, 3), label: str = "label", groups: Sequence[str] = (),
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The (feature, threshold) with the largest Gini gain per group over every distinct value, with
    class counts on both sides. The threshold is the middle between the two values it parts.

    Equal values are merged first; class counts up to a value are running sums in value order,
    which cut a hot group into ordered buckets. Of equal gains (to nine digits) the first feature
    and the least value win. Rows of other classes, and rows without a value (NULL or NaN) of a
    feature, are not counted for it; a group whose features have one value each has no cut.
    """
    g = list(groups)
    long = melt(df.where(F.col(label).isin(*classes)), [*g, label], cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    per_value = stored(long.groupBy(*g, "feature", "value").agg(*[F.count_if(F.col(label) == c).cast("double").alias(f"n{c}") for c in classes]), "values")
    totals = per_value.groupBy(*g, "feature").agg(*[F.sum(f"n{c}").alias(f"t{c}") for c in classes])
    run = running(per_value, [*g, "feature"], "value", {f"l{c}": F.col(f"n{c}") for c in classes}, rows_per_task=rows_per_task)
    left = join_small(run.drop(*[f"n{c}" for c in classes]), totals, [*g, "feature"])
    add = lambda prefix: sum((F.col(f"{prefix}{c}") for c in classes[1:]), F.col(f"{prefix}{classes[0]}"))
    l_tot, t_tot = add("l"), add("t")
    r_tot = t_tot - l_tot
    impurity = lambda parts, total: F.lit(1.0) - sum((p / total) * (p / total) for p in parts)
    gain = (impurity([F.col(f"t{c}") for c in classes], t_tot) - l_tot / t_tot * impurity([F.col(f"l{c}") for c in classes], l_tot)
            - r_tot / t_tot * impurity([F.col(f"t{c}") - F.col(f"l{c}") for c in classes], r_tot))
    scored = left.where(r_tot > 0).withColumn("gain", F.round(gain, 9))
    counts = [f"{p}{c}" for p in "lt" for c in classes]
    # The least of (-gain, feature, value): a row per task and group reaches the shuffle.
    best = scored.groupBy(*g).agg(F.min(F.struct((-F.col("gain")).alias("neg"), "feature", "value", *counts)).alias("b"))
    best = stored(best.select(*g, "b.*"), "best-cuts").where("feature is not null")
    above = per_value.withColumnRenamed("value", "other")
    met = join_small(above.select(*g, "feature", "other"), best, [*g, "feature"]).where("other > value")
    after = met.groupBy(*g, "feature", "value", "neg", *counts).agg(F.min("other").alias("next"))
    return after.select(*g, "feature", ((F.col("value") + F.col("next")) / 2).alias("threshold"), (-F.col("neg")).alias("gain"), *counts)


def cut_report(best: DataFrame, names: dict[int, str], groups: Sequence[str] = ()) -> DataFrame:
    """Share of every class on both sides of the cut, and the sentences describing it."""
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(n).alias("label_name"),
                              F.try_divide(F.lit(100.0) * F.col(f"l{c}"), F.nullif(F.col(f"t{c}"), F.lit(0))).alias("pct_below"),
                              F.try_divide(F.lit(100.0) * (F.col(f"t{c}") - F.col(f"l{c}")), F.nullif(F.col(f"t{c}"), F.lit(0))).alias("pct_above"))
                     for c, n in names.items()])
    out = best.select(*groups, "feature", "threshold", "gain", F.explode(rows).alias("r")).select(
        *groups, "feature", "threshold", "gain", "r.*")
    # A class without rows has no share and no sentence.
    one = lambda col, op: F.when(F.col(col).isNotNull(), F.format_string(
        f"%s {op} %.3f keeps %.1f%% of our %s jets", F.col("feature"), F.col("threshold"), F.col(col), F.col("label_name")))
    return out.withColumn("below_text", one("pct_below", "<=")).withColumn("above_text", one("pct_above", ">"))
