"""Counts, moments, histograms, correlations and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import density_bin, fixed_bin, hexbin_centres
from ..functions.ordering import ROWS_PER_TASK, grouped_quantiles, join_small, lagged
from ..session import stored


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "feature", val: str = "value") -> DataFrame:
    """Long form of several double columns."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), list(cols), var, val)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def describe(df: DataFrame, cols: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """count, mean, sample standard deviation, min, exact quartiles and max per column."""
    long = melt(df, [], cols).where(F.col("value").isNotNull())
    basic = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quart = grouped_quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, rows_per_task=rows_per_task)
    return basic.join(quart, "feature")


# Widest single aggregate: beyond it generated code gets too large and the first column of the pairs
# becomes a grouping key.
MAX_WIDE_PAIRS = 24


def _pair_aggregate(df: DataFrame, pairs: Sequence[tuple[str, str]], fn, name: str) -> DataFrame:
    """(a, b, fn(a, b)) for column pairs in one pass over the rows."""
    if len(pairs) <= MAX_WIDE_PAIRS:
        agg = df.agg(*[fn(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias(name))
                          for i, (a, b) in enumerate(pairs)])
        return agg.select(F.explode(cells).alias("c")).select("c.*")
    firsts, seconds = list(dict.fromkeys(a for a, _ in pairs)), list(dict.fromkeys(b for _, b in pairs))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("double").alias("x")) for a in firsts])
    out = None
    for i in range(0, len(seconds), MAX_WIDE_PAIRS):
        some = seconds[i:i + MAX_WIDE_PAIRS]
        # Positions, not names: a column may be called like the key.
        wide = df.select(F.explode(cells).alias("_c"), *[F.col(b).cast("double").alias(f"_{k}") for k, b in enumerate(some)])
        per = wide.groupBy(F.col("_c.a").alias("a")).agg(*[fn("_c.x", f"_{k}").alias(f"r{k}") for k in range(len(some))])
        flat = F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"r{k}").alias(name)) for k, b in enumerate(some)])
        part = per.select("a", F.explode(flat).alias("c")).select("a", "c.*")
        out = part if out is None else out.unionByName(part)
    wanted = F.array(*[F.concat_ws("\0", F.lit(a), F.lit(b)) for a, b in pairs])
    return out.where(F.array_contains(wanted, F.concat_ws("\0", "a", "b")))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of all column pairs, long form. Only one triangle is computed."""
    half = _pair_aggregate(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]], F.corr, "corr")
    mirror = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select("corr", F.explode(mirror).alias("p")).select("p.a", "p.b", "corr")


def covariance_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _pair_aggregate(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]], F.covar_samp, "cov")


def density_histogram(df: DataFrame, cols: Sequence[str], n_bins: int, label: str = "label",
                      classes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Density histograms of every column, for all rows (class 0) and per class, each over its own
    range. One pass for the ranges, one for the counts, for all columns and classes together. Rows
    of any other class, or of none, are among all rows."""
    if 0 in classes:
        raise ValueError("class 0 stands for all rows here; give the classes other numbers")
    groups = [("0", F.lit(True))] + [(str(c), F.col(label) == c) for c in classes]
    bounds = df.groupBy().agg(*[
        f(F.when(cond, F.col(c))).cast("double").alias(f"{p}_{g}_{c}")
        for c in cols for g, cond in groups for f, p in ((F.min, "lo"), (F.max, "hi"))])
    # One (column, class) range per row: bounded by the number of columns and classes.
    ranges = bounds.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(int(g)).alias("grp"), F.col(f"lo_{g}_{c}").alias("lo"), F.col(f"hi_{g}_{c}").alias("hi"))
        for c in cols for g, _ in groups])).alias("r")).select("r.*")
    long = melt(df, [label], cols).where(F.col("value").isNotNull())
    own = F.when(F.col(label).isin(*classes), F.col(label).cast("int"))
    long = long.withColumn("grp", F.explode(F.array_compact(F.array(F.lit(0), own))))
    counts = long.join(F.broadcast(ranges), ["feature", "grp"]).withColumn(
        "bin", density_bin(F.col("value"), F.col("lo"), F.col("hi"), n_bins)).groupBy("feature", "grp", "bin").agg(F.count("*").alias("n"))
    grid = ranges.where(F.col("lo").isNotNull()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    filled = grid.join(counts, ["feature", "grp", "bin"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("feature", "grp"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    return filled.select("feature", "grp", "bin", (F.col("lo") + width * F.col("bin")).alias("left_edge"), "n",
                         F.try_divide(F.col("n"), F.nullif(total * width, F.lit(0.0))).alias("density"))


def fixed_histogram(df: DataFrame, x: Column, lo: float, hi: float, n: int, groups: Sequence[str] = (),
                    weight: Column | None = None) -> DataFrame:
    """Fixed-range histogram with underflow (0) and overflow (n+1) bins, errors as sum of squared
    weights."""
    w = F.lit(1.0) if weight is None else weight
    return (df.select(*groups, fixed_bin(x, lo, hi, n).alias("bin"), w.alias("_w")).where(F.col("bin").isNotNull())
            .groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.sum("_w").alias("sumw"), F.sum(F.col("_w") * F.col("_w")).alias("sumw2")))


def normalize_histogram(hist: DataFrame, width: float, groups: Sequence[str] = ()) -> DataFrame:
    """Counts over entries (under- and overflow included) over bin width, in-range bins only."""
    entries = F.sum("n").over(Window.partitionBy(*groups))
    return hist.withColumn("density", F.col("n") / entries / F.lit(width))


def histogram_2d(df: DataFrame, x: Column, xs: tuple[float, float, int], y: Column, ys: tuple[float, float, int],
                 groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    binned = df.select(*groups, fixed_bin(x, *xs).alias("bin_x"), fixed_bin(y, *ys).alias("bin_y"), w.alias("_w"))
    return binned.where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull()).groupBy(*groups, "bin_x", "bin_y").agg(
        F.count("*").alias("n"), F.sum("_w").alias("sumw"), F.sum(F.col("_w") * F.col("_w")).alias("sumw2"))


def auto_histogram_2d(df: DataFrame, x: str, y: str, n: int, groups: Sequence[str] = ()) -> DataFrame:
    """2-D counts over the observed range of each group, n x n bins, last bins closed."""
    b = df.groupBy(*groups).agg(F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh"))
    j = join_small(df.select(*groups, x, y), b, groups) if groups else _with_row(df.select(x, y), b)
    return j.select(*groups, density_bin(F.col(x), F.col("xl"), F.col("xh"), n).alias("bin_x"),
                    density_bin(F.col(y), F.col("yl"), F.col("yh"), n).alias("bin_y")).groupBy(*groups, "bin_x", "bin_y").agg(F.count("*").alias("n"))


def _with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate as literals."""
    row = one_row.first()
    return df.select("*", *[F.lit(row[c]).alias(c) for c in one_row.columns])


def hexbin(df: DataFrame, x: str, y: str, grid: int = 20) -> DataFrame:
    """Hexagonal counts with the log10(n + 1) colour value."""
    b = df.groupBy().agg(F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh"))
    lattice, ix, iy = hexbin_centres(F.col(x), F.col(y), F.col("xl"), F.col("xh"), F.col("yl"), F.col("yh"), grid)
    return _with_row(df.select(x, y), b).select(lattice.alias("lattice"), ix.alias("ix"), iy.alias("iy")).groupBy(
        "lattice", "ix", "iy").agg(F.count("*").alias("n")).withColumn("color", F.log10(F.col("n") + 1))


def pair_histograms(df: DataFrame, cols: Sequence[str], n: int, label: str = "label",
                    pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Per-class 2-D counts of column pairs over each column's observed range: the content of a
    scatter matrix in bounded size. All pairs share one pass."""
    b = df.groupBy().agg(*[f(c).alias(f"{p}_{c}") for c in cols for f, p in ((F.min, "lo"), (F.max, "hi"))])
    row = b.first()
    binned = df.select(label, *[density_bin(F.col(c), F.lit(row[f"lo_{c}"]), F.lit(row[f"hi_{c}"]), n).alias(c) for c in cols])
    pairs = pairs or [(p, q) for i, p in enumerate(cols) for q in cols[i + 1:]]
    cells = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(p).alias("bin_x"), F.col(q).alias("bin_y")) for p, q in pairs])
    return binned.select(label, F.explode(cells).alias("c")).groupBy(label, "c.a", "c.b", "c.bin_x", "c.bin_y").agg(
        F.count("*").alias("n"))


def profile(df: DataFrame, a: str, b: str, n_bins: int = 20, *, strict_edges: bool = False,
            rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Values of ``b`` by bin of ``a``.

    The default bins tile the range. ``strict_edges`` spaces the left edges so that the last one is
    the maximum and leaves both ends open, which loses edge values and the gaps between bins.
    """
    row = df.agg(F.min(a).alias("lo"), F.max(a).alias("hi")).first()
    lo, hi = F.lit(row["lo"]), F.lit(row["hi"])
    width = (hi - lo) / n_bins
    if strict_edges:
        step = (hi - lo) / (n_bins - 1)
        # A flat column has one edge, which the open bins leave out.
        bin_ = F.floor(F.try_divide(F.col(a) - lo, step)).cast("int")
        left = lo + step * bin_
        rows = df.select(a, b).withColumn("bin", bin_).where((F.col(a) > left) & (F.col(a) < left + width))
    else:
        rows = df.select(a, b).withColumn("bin", density_bin(F.col(a), lo, hi, n_bins))
    basic = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(b).alias("mean"))
    return basic.join(grouped_quantiles(rows, ["bin"], b, {"median": 0.5}, rows_per_task=rows_per_task), "bin")


def counters(df: DataFrame, kind: str) -> DataFrame:
    c = df.groupBy(kind).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def accuracy(df: DataFrame, pred: str = "pred", label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def class_rates(df: DataFrame, pred: str = "pred", label: str = "label", split: str = "split") -> DataFrame:
    return df.groupBy(split, label).agg(F.count("*").alias("n"), F.avg((F.col(pred) == F.col(label)).cast("double")).alias("rate"))


def confusion(df: DataFrame, pred: str = "pred", label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, label, pred).agg(F.count("*").alias("n"))


def fall_rates(df: DataFrame, pred: str = "pred", label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    """Share of fakes called real and of reals called fake."""
    rate = lambda true, called: F.avg(F.when(F.col(label) == true, (F.col(pred) == called).cast("double")))
    return df.groupBy(*groups).agg(rate(1, 3).alias("fall_out"), rate(3, 1).alias("fall_in"))


def metric_mean(df: DataFrame, groups: Sequence[str], value: str = "value", compat: bool = False) -> DataFrame:
    """Average over models; ``compat`` divides by one more than the number of models."""
    n = F.count(value) + (1 if compat else 0)
    return df.groupBy(*groups).agg((F.sum(value) / n).alias("mean"), F.count(value).alias("n_models"))


def interval_gaps(df: DataFrame, ts: str, key: str, groups: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Differences of successive time stamps of a group, in seconds."""
    secs = df.select(*groups, key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    seen = lagged(secs, groups, "us", key, name="prev", rows_per_task=rows_per_task).where(F.col("prev").isNotNull())
    return seen.select(*groups, ((F.col("us") - F.col("prev")) / 1e6).alias("gap"))


def interval_stats(gaps: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return gaps.groupBy(*groups).agg(F.count("*").alias("n"), F.sum("gap").alias("total"), F.avg("gap").alias("mean"))


def interval_histogram(gaps: DataFrame, n_bins: int = 8) -> DataFrame:
    """Differences on [mean - 1, mean + 1). They are written once: for the mean and for the bins."""
    gaps = stored(gaps.select("gap"), "gaps")
    mean = gaps.agg(F.avg("gap")).first()[0] or 0.0
    return fixed_histogram(gaps, F.col("gap"), mean - 1, mean + 1, n_bins)
