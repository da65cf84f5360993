"""Reproducible balancing, splitting and folding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60
from ..functions.ordering import hash_ranked

COPIES_PER_ROW = 1_000


def balance_classes(df: DataFrame, keys: Sequence[str], *, label: str = "label", anchor: int = 3,
                    others: Sequence[int] = (1, 2), seed: int = 42) -> DataFrame:
    """All rows of the anchor class, and as many draws with replacement from every other class.

    Draw d of class c takes the row whose ordinal inside the class is hash(seed, c, d) mod N_c.
    Draws are counted per (class, ordinal) before they meet the rows, so each row is joined once
    and copied afterwards. Copies are made in blocks of COPIES_PER_ROW spread over tasks: a class
    with a handful of rows does not put all its copies into one task. Adds ``copy`` (0 for anchor
    rows, 1.. for draws), which makes (keys, copy) unique.
    """
    rows = hash_ranked(df.where(F.col(label).isin(*others)), [label], keys, seed=seed, name="_ord", size="_n")
    n_anchor = df.where(F.col(label) == anchor).count()
    if n_anchor == 0:
        raise ValueError(f"no rows of anchor class {anchor}: nothing to balance against")
    spark = df.sparkSession
    # One row per other class: bounded by the number of classes.
    sizes = F.broadcast(df.where(F.col(label).isin(*others)).groupBy(label).agg(F.count("*").alias("_nc")))
    draws = (spark.range(1, n_anchor + 1).withColumn(label, F.explode(F.array(*[F.lit(c) for c in others])))
             .join(sizes, label)
             .withColumn("_ord", F.pmod(hash60(F.col(label), F.col("id"), seed=seed), F.col("_nc")) + 1)
             .groupBy(label, "_ord").agg(F.count("*").alias("_m")))
    blocks = draws.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_m - 1) div {COPIES_PER_ROW}"))))
    picked = rows.join(blocks, [label, "_ord"]).repartition(F.col("_ord"), F.col("_blk"))
    first = F.col("_blk") * COPIES_PER_ROW + 1
    last = F.least(F.col("_m"), (F.col("_blk") + 1) * COPIES_PER_ROW)
    drawn = picked.select(*df.columns, F.explode(F.sequence(first, last)).alias("copy"))
    kept = df.where(F.col(label) == anchor).withColumn("copy", F.lit(0).cast("bigint"))
    return kept.unionByName(drawn)


def approx_balance(df: DataFrame, *, label: str = "label", anchor: int = 3, others: Sequence[int] = (1, 2),
                   seed: int = 42) -> DataFrame:
    """Balanced in expectation: independent sampling with replacement per class, no ranks, no joins."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isin(anchor, *others)).groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts.get(anchor):
        raise ValueError(f"no rows of anchor class {anchor}: nothing to balance against")
    out = df.where(F.col(label) == anchor)
    for c in others:
        if counts.get(c):
            out = out.unionByName(df.where(F.col(label) == c).sample(True, counts[anchor] / counts[c], seed))
    return out


def train_test_split(df: DataFrame, keys: Sequence[str], *, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact split: the ceil(share * n) rows that come first in hash order are the test set."""
    r = hash_ranked(df, [], keys, seed=seed, name="_ord", size="_n")
    n_test = F.ceil(F.round(F.lit(test_share) * F.col("_n"), 6))
    return r.select(*df.columns, F.when(F.col("_ord") <= n_test, "test").otherwise("train").alias("split"))


def hash_split(df: DataFrame, keys: Sequence[str], *, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Shuffle-free split: membership follows from the row's own hash; sizes are right on average."""
    bucket = F.pmod(hash60(*keys, seed=seed), F.lit(10_000))
    return df.withColumn("split", F.when(bucket < int(test_share * 10_000), "test").otherwise("train"))


def k_fold(df: DataFrame, keys: Sequence[str], *, k: int = 5, label: str = "label", seed: int = 42) -> DataFrame:
    """Stratified fold number 0..k-1."""
    r = hash_ranked(df, [label], keys, seed=seed, name="_ord", size="_n")
    return r.select(*df.columns, F.pmod(F.col("_ord") - 1, F.lit(k)).cast("int").alias("fold"))


CHUNK_ROWS = 1_000_000


def chunks(df: DataFrame, keys: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunk number such that a chunk has about ``rows`` rows; a table of fewer is one chunk."""
    return batches(df, keys, max(1, -(-df.count() // rows)))


def batches(df: DataFrame, keys: Sequence[str], n_batches: int, seed: int | str = "batch") -> DataFrame:
    """Deterministic chunk number without a shuffle."""
    return df.withColumn("batch_id", F.pmod(hash60(*keys, seed=seed), F.lit(n_batches)).cast("int"))
