"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jetforge import session
from jetforge.session import shared_path, stored

__all__ = ["WORD_SEPARATORS", "ascii_lower", "configure", "ids_of", "renamed", "shared_path", "stored", "table", "words_of"]

# Fixed value: the white space between words, as a character class (space and x09 to x0D).
WORD_SEPARATORS = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_ROWS = 2000  # rows handed to Python at once: texts can be long


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return session.configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A to Z become lower case, every other character stays (``lower`` would change accents too)."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str = WORD_SEPARATORS) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ids_of(df: DataFrame, id_cols: list[str] | tuple[str, ...]) -> list[Column]:
    """The identifying columns under private names, so that no extra column can clash."""
    return [quoted(c).alias(f"_id{i}") for i, c in enumerate(id_cols)]


def renamed(id_cols: list[str] | tuple[str, ...]) -> list[Column]:
    """The identifying columns under their own names again."""
    return [F.col(f"_id{i}").alias(c) for i, c in enumerate(id_cols)]


def valid_name(name: str) -> str:
    return re.sub(r"\W", "_", name)
