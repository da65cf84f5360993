"""Corpus preparation: filter, deduplicate, decontaminate, mix and shard the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetforge.llm import decontaminate, mixing, quality, sharding, simhash
from jetforge.llm.common import configure, stored, table


def whole(docs: DataFrame) -> DataFrame:
    """The documents with all their columns once more as one column, to be carried along."""
    return docs.withColumn("doc", F.struct(*docs.columns))


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order: a row for each pass the mix makes over a document."""
    placed = mixing.mix(whole(docs), id_cols=("doc",), reread=True)
    return mixing.curriculum(placed.select("doc", "passes")).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; where they have a column of that name, the new one gets
    an underscore more."""
    placed = sharding.shard(whole(docs), keep_cols=("doc",))
    return placed.select("doc.*", *[F.col(c).alias(free(c, docs.columns)) for c in ("shard", "slot")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good),
    ("near duplicates", unique),
    ("decontamination", clean),
    ("mixing", mixed),
    ("sharding", sharded),
]

# Language references, fingerprints and multi-round boundaries are beyond one SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
