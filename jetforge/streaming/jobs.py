"""Streaming forms of the chunk loop and of fill-as-you-go histograms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.binning import fixed_bin
from ..session import shared_path, stored
from ..sources.committed import append_once, is_committed, read_committed


CHUNKS_AT_ONCE = 8


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def write_chunks(rows: DataFrame, path: str, rows_per_file: int, chunk: str = "chunk") -> None:
    """Files for a stream of chunks, in which the rows of a chunk follow each other: spread over all
    files, each chunk would be staged in a file for every batch."""
    rows.hint("rebalance", chunk).sortWithinPartitions(chunk).write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def stream_histogram(stream: DataFrame, x: Column, lo: float, hi: float, n: int, groups: Sequence[str] = ()) -> DataFrame:
    """Running fixed-range histogram of a stream; its state is one row per (group, bin)."""
    return stream.select(*groups, fixed_bin(x, lo, hi, n).alias("bin")).where(F.col("bin").isNotNull()).groupBy(*groups, "bin").agg(
        F.count("*").alias("n"))


def run_complete(counts: DataFrame, name: str) -> DataFrame:
    """Drain the stream into a result table in the shared folder and return its final state."""
    spark = counts.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (counts.writeStream.outputMode("complete").option("checkpointLocation", state)
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return spark.read.parquet(out)


def micro_batches(stream: DataFrame, per_batch: Callable[[DataFrame, int], DataFrame], name: str) -> DataFrame:
    """One result per arriving chunk. The epoch names the output partition and is overwritten on a
    retry, so a restarted batch leaves one result."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")

    def save(batch: DataFrame, epoch: int) -> None:
        per_batch(batch, epoch).write.mode("overwrite").parquet(f"{out}/batch_id={epoch}")

    query = (stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return spark.read.parquet(out)


def per_complete_chunk(stream: DataFrame, manifest: DataFrame, per_chunk: Callable[[DataFrame], DataFrame], result: str, name: str, *,
                       chunk: str = "chunk", staging: str | None = None, out: str | None = None, state: str | None = None) -> DataFrame:
    """One result per chunk of a stream whose chunks arrive in any number of files, once all rows
    that ``manifest`` (chunk, rows) announces of it are there. ``result`` is the results' schema.

    Arriving rows are staged under the number of their batch, which a repeated batch replaces.
    Results are committed under the name of their chunk, so that a replay of the whole stream, or of
    a batch that failed half way, adds no second one. Chunks that stay incomplete have no result;
    rows of chunks that nobody announced wait in the staging folder.
    """
    spark = stream.sparkSession
    staging, out, state = (given or shared_path(spark, f"{name}-{kind}") for given, kind in ((staging, "staging"), (out, "results"), (state, "state")))
    expected = stored(manifest.select(F.col(chunk).alias("_c"), F.col("rows").alias("_rows")), f"{name}-manifest")

    def save(batch: DataFrame, epoch: int) -> None:
        # A file per chunk and batch, and their row counts beside them: no later batch opens them all.
        batch.repartition(chunk).write.mode("overwrite").partitionBy(chunk).parquet(f"{staging}/epoch={epoch}")
        mine = spark.read.schema(batch.schema).parquet(f"{staging}/epoch={epoch}").groupBy(F.col(chunk).alias("_c")).agg(F.count("*").alias("_held"))
        mine.withColumn("_epoch", F.lit(epoch).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{staging}/_rows/epoch={epoch}")
        counts = spark.read.schema("_c {}, _held long, _epoch long".format(batch.schema[chunk].dataType.simpleString())).parquet(f"{staging}/_rows/epoch=*")
        arrived = counts.groupBy("_c").agg(F.sum("_held").alias("_held"), F.collect_list("_epoch").alias("_epochs"))
        # Chunks that became whole, with the batches that brought them: a few numbers for each.
        ready = arrived.join(expected, "_c").where((F.col("_held") >= F.col("_rows")) & F.array_contains("_epochs", epoch)).select("_c", F.col("_c").cast("string"), "_epochs").collect()

        def settle(row) -> None:
            number, folder, epochs = row
            if not is_committed(spark, out, f"chunk-{number}"):
                held = spark.read.schema(batch.schema).option("basePath", staging).parquet(*[f"{staging}/epoch={e}/{chunk}={folder}" for e in epochs])
                append_once(per_chunk(held.where(F.col(chunk) == number)), out, f"chunk-{number}")

        with ThreadPool(CHUNKS_AT_ONCE) as pool:
            pool.map(inheritable_thread_target(spark)(settle), ready, chunksize=1)

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return read_committed(spark, out, result).drop("run")
