"""A folder of data files that begin with a line of settings: listed, selected by their settings,
and read.

Listing opens no file. Of a file only its first bytes are read to learn its settings, by the tasks
that hold its name, and only selected files are opened for their rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 4096  # the settings have to fit into these
FILES_PER_TASK = 256
# Schemes of paths that can be read from a place on, and what they are called there.
RANGED = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """path and length of the files below a folder whose names end in ``suffix``; empty ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.where(F.col("path").endswith(suffix)) if suffix else files


def _first_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        heads = []
        for path in batch.column(0).to_pylist():
            parts = urlsplit(path)
            if parts.scheme == "file":
                system, name = fs.LocalFileSystem(), unquote(parts.path)
            else:
                system, name = fs.FileSystem.from_uri(path.replace(parts.scheme, RANGED[parts.scheme], 1))
            with system.open_input_file(name) as f:
                heads.append(f.read(HEADER_BYTES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["path", "head"])


def file_headers(spark: SparkSession, folder: str, names: Sequence[str], suffix: str = "", mark: str = "#") -> DataFrame:
    """path, length and the settings ``names`` (whole numbers; NULL where a file has none) of every
    file below a folder whose name ends in ``suffix``.

    The settings are the first line: ``mark``, then name=value pairs apart by blanks. Paths that
    cannot be read from a place on are read whole.
    """
    files = list_files(spark, folder, suffix)
    first = files.select("path").first()
    if first and urlsplit(first["path"]).scheme in RANGED:
        n = files.count()
        heads = files.select("path").repartition(max(1, -(-n // FILES_PER_TASK))).mapInArrow(_first_bytes, "path string, head binary")
    else:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        heads = whole.where(F.col("path").endswith(suffix)).select("path", F.substring("content", 1, HEADER_BYTES).alias("head"))
    line = F.substring_index(F.decode("head", "UTF-8"), "\n", 1)
    pairs = F.when(F.startswith(line, F.lit(mark)), F.str_to_map(F.trim(F.substring(line, len(mark) + 1, HEADER_BYTES)), F.lit(r"[ \t\r]+"), F.lit("=")))
    found = heads.select("path", pairs.alias("pairs")).select("path", *[F.try_element_at("pairs", F.lit(n)).try_cast("bigint").alias(n) for n in names])
    return files.join(found, "path")


def read_files(spark: SparkSession, catalog: DataFrame, schema: str, mark: str = "#") -> DataFrame:
    """Rows of the cataloged files, with their ``path``. The reader takes a list of names: one for
    every selected file."""
    paths = [r["path"] for r in catalog.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], f"{schema}, path string")
    rows = spark.read.schema(schema).option("comment", mark).csv(sorted(paths))
    # The reader's name of a file is escaped and has an empty host; listed paths are neither.
    name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    return rows.withColumn("path", F.regexp_replace(name, "^([a-z0-9]+):///", "$1:/"))
