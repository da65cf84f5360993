"""Typing, derived columns, labels, feature subsets and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import cut_right_closed, label_names
from ..functions.ordering import join_small
from ..schema import CLASS_CODES, COUNT_COLUMNS, DROP_LISTS, JET_COLUMNS, LABEL_NAMES, LEAKY


def type_jets(df: DataFrame, float32: bool = False) -> DataFrame:
    """Cast the jet columns of a string table: counts to bigint, the rest to double (optionally
    rounded through float32). Malformed values become NULL; other columns pass through."""
    def cast(name: str) -> Column:
        if name not in JET_COLUMNS:
            return F.col(name)
        if name in COUNT_COLUMNS:
            return F.col(name).try_cast("double").cast("bigint").alias(name)
        c = F.col(name).try_cast("float").cast("double") if float32 else F.col(name).try_cast("double")
        return c.alias(name)

    return df.select(*[cast(c) for c in df.columns])


def signal_momentum(df: DataFrame, x: str = "x_tru", n: str = "n_trk", name: str = "pythia_mom") -> DataFrame:
    return df.withColumn(name, F.col(x) * F.col(n))


def label_rows(df: DataFrame, metric: str, edges: Sequence, labels: Sequence[int],
               names: Sequence[str] = LABEL_NAMES, strict: bool = False) -> DataFrame:
    label = cut_right_closed(F.col(metric), edges, labels, strict)
    return df.withColumn("label", label).withColumn("label_name", label_names(F.col("label"), names))


def drop_features(df: DataFrame, keep: str = "lean") -> DataFrame:
    return df.drop(*DROP_LISTS[keep])


def feature_label_split(df: DataFrame, label: str = "label", keep_leaky: bool = False) -> DataFrame:
    """Feature columns plus the label. The columns the label is cut from are dropped unless the
    caller asks for the older behaviour."""
    drop = [c for c in LEAKY if c != label]
    if keep_leaky:
        drop = [c for c in drop if c not in ("pythia_mom", "tru_sum")]
    return df.drop(*drop)


def low_pt(df: DataFrame, adaptive: bool = False) -> DataFrame:
    bound = F.lit(100.0) if not adaptive else F.lit(100.0) + (F.col("pt_hard_min") / 10.0 - 1.0) * 20.0
    return df.where(F.col("p_t") < bound)


def class_filter(df: DataFrame, keep: Sequence[int] | None = None, drop: Sequence[int] | None = None) -> DataFrame:
    if keep is not None:
        df = df.where(F.col("label").isin(*keep))
    return df if drop is None else df.where(~F.col("label").isin(*drop))


def minmax_scale(df: DataFrame, cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min) per column, over the table or per group; a constant column gives 0."""
    bounds = df.groupBy(*groups).agg(*[f(c).alias(f"_{p}_{c}") for c in cols for f, p in ((F.min, "lo"), (F.max, "hi"))])
    if groups:
        out = join_small(df, bounds, groups)
    else:
        # A single row of bounds, read once and put into the plan as literals.
        row = bounds.first()
        out = df.select("*", *[F.lit(row[c]).alias(c) for c in bounds.columns])
    scaled = lambda c: F.coalesce(
        F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0))), F.lit(0.0))
    return out.select(*[scaled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def class_encode(name: Column) -> Column:
    codes = F.create_map(*[F.lit(v) for kv in CLASS_CODES.items() for v in kv])
    return F.try_element_at(codes, name)


def particle_cut(df: DataFrame, pt_cut: float = 0.15, eta_cut: float = 0.9, status: Column | None = None) -> DataFrame:
    cond = (F.col("pt") > pt_cut) & (F.abs("eta") < eta_cut)
    return df.where(cond if status is None else cond & (status == 1))


def jet_cut(df: DataFrame, pt_lo: float | Column = 10.0, pt_hi: float = 10000.0, eta_max: float = 0.9,
            radius: Column | None = None) -> DataFrame:
    r = F.lit(0.2) + F.lit(0.1) * F.col("r_idx") if radius is None else radius
    return df.where((F.col("p_t") >= pt_lo) & (F.col("p_t") <= pt_hi) & (F.abs("eta") < F.lit(eta_max) - r))
