"""CSV shards of the jet table, and the partitioned dataset that replaces them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash60
from ..functions.ordering import ROWS_PER_TASK, join_small, ranked, running
from ..operators.prep import type_jets
from ..schema import CSV_COLUMNS, SNAKE, csv_schema

SHARD_ROWS = 50_000


def read_raw(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = CSV_COLUMNS) -> DataFrame:
    """Positional read with caller-supplied names; every field is a string, header lines included."""
    return (spark.read.schema(csv_schema(list(columns))).option("header", False)
            .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
            .csv(paths if isinstance(paths, str) else list(paths)))


def drop_repeated_headers(df: DataFrame, probe: str = "Eps") -> DataFrame:
    """Remove header lines left inside concatenated shards (null-safe, blanks around names allowed)."""
    return df.where(F.coalesce(F.trim(F.col(f"`{probe}`")) != probe, F.lit(True)))


def rename_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: SNAKE[c] for c in df.columns if c in SNAKE})


def header_probe(columns: Sequence[str]) -> str:
    """A column of the layout whose name gives a header line away."""
    return "Eps" if "Eps" in columns else "p_T"


def read_jets(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = CSV_COLUMNS,
              float32: bool = False) -> DataFrame:
    """Typed jet table from shards. ``columns`` states the layout; it is never guessed."""
    return type_jets(rename_columns(drop_repeated_headers(read_raw(spark, paths, columns), header_probe(columns))), float32)


def row_cap(df: DataFrame, key: str, n: int, tie: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The first n rows in key order. Every task keeps its own first n ahead of the exchange; beyond
    ``rows_per_task`` rows the cap is taken by rank, so that no task holds them all."""
    order = list(dict.fromkeys([key, tie or key]))
    if n <= rows_per_task:
        return df.orderBy(*order).limit(n)
    return ranked(df, [], key, tie or key, name="_r", rows_per_task=rows_per_task).where(F.col("_r") <= n).drop("_r")


def _csv_frame(df: DataFrame) -> DataFrame:
    back = {v: k for k, v in SNAKE.items() if k != "Rho"}
    return df.select(*[F.col(SNAKE[c]).alias(c) for c in CSV_COLUMNS if SNAKE[c] in df.columns],
                     *[c for c in df.columns if c not in back])


def append_jets(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows as CSV; every written file starts with the header."""
    rows = _csv_frame(df)
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
    w = rows.write.mode("append").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def split_shards(df: DataFrame, path: str, rows: int = SHARD_ROWS) -> None:
    """CSV files of at most ``rows`` rows, the header on each."""
    _csv_frame(df).write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).csv(path)


def merge_shards(spark: SparkSession, glob: str, columns: Sequence[str] = CSV_COLUMNS) -> DataFrame:
    """All shards of all grid points in one typed table; R and pt_hard_min come from the file path
    (``...Rparam-0.4...pThardmin-20...`` or ``R=0.4/pt_hard_min=20``)."""
    raw = drop_repeated_headers(read_raw(spark, glob, columns), header_probe(columns)).withColumn("_file", F.input_file_name())
    r = F.regexp_extract("_file", r"(?:Rparam-|R=)(\d+\.\d+)", 1)
    p = F.regexp_extract("_file", r"(?:pThardmin-|pt_hard_min=)(\d+)", 1)
    tagged = raw.withColumn("R", r.try_cast("double")).withColumn("pt_hard_min", p.try_cast("int")).drop("_file")
    return type_jets(rename_columns(tagged))


def write_grid(df: DataFrame, path: str, by: Sequence[str] = ("R", "pt_hard_min")) -> None:
    """The jet dataset, one directory per grid point. The rebalance hint sizes the write tasks at run
    time: small grid points share a task, a grid point holding most rows is split over many."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def read_grid(spark: SparkSession, path: str, points: Sequence[tuple[float, int]] | None = None,
              skip: Sequence[tuple[float, int]] = ()) -> DataFrame:
    """Grid points as partition filters; without arguments the whole sweep."""
    df = spark.read.parquet(path)
    match = lambda p: (F.round("R", 3) == p[0]) & (F.col("pt_hard_min") == p[1])
    if points is not None:
        cond = F.lit(False)
        for p in points:
            cond = cond | match(p)
        df = df.where(cond)
    for p in skip:
        df = df.where(~match(p))
    return df


def write_tables(df: DataFrame, path: str) -> None:
    """The five jet tables as one dataset partitioned by ``source``."""
    df.hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(path)


def catalog_scan(catalog: DataFrame, *, suffix: str = "", name: str = "file", **wanted) -> DataFrame:
    """Files whose name ends in ``suffix`` and whose header equals the requested settings."""
    cond = F.col(name).cast("string").endswith(suffix) if suffix else F.lit(True)
    for key, value in wanted.items():
        cond = cond & (F.col(key) == value)
    return catalog.where(cond)


def scan_files(rows: DataFrame, catalog: DataFrame, name: str = "file") -> DataFrame:
    return rows.join(catalog.select(name), name, "left_semi")


def shuffled_read(df: DataFrame, file: str, event: str, seed: int = 42) -> DataFrame:
    """Position of every event in a reproducible random order: files first, events inside a file
    next."""
    inside = ranked(df.withColumn("_h", hash60(event, seed=f"{seed}:event")), [file], "_h", event, name="_in")
    files = df.groupBy(file).agg(F.count("*").alias("_fn")).withColumn("_fh", hash60(file, seed=f"{seed}:file"))
    start = running(files, [], "_fh", {"_end": F.col("_fn")}, key=file).select(file, (F.col("_end") - F.col("_fn")).alias("_start"))
    return join_small(inside, start, [file]).select(*df.columns, (F.col("_start") + F.col("_in")).alias("position"))


def filtered_draw(df: DataFrame, predicate: str, expression: str, name: str = "x") -> DataFrame:
    return df.where(F.expr(predicate)).select(F.expr(expression).alias(name))
