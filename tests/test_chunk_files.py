"""A chunk's rows lie in few files of the stream, whatever the number of chunks."""

from pyspark.sql import functions as F

from jetforge.functions.hashing import hash60
from jetforge.streaming import jobs


def test_files_of_a_chunk_follow_each_other(spark, tmp_path):
    rows = spark.range(6000).select("id", F.pmod(hash60("id"), F.lit(60)).cast("int").alias("chunk"))
    path = str(tmp_path / "in")
    jobs.write_chunks(rows, path, 50)
    found = spark.read.parquet(path).select("id", "chunk", F.input_file_name().alias("file"))
    assert found.groupBy("file").count().agg(F.max("count")).first()[0] <= 50
    # About 100 rows: two or three files. Dealt to all files, a chunk was in nearly all of 120.
    assert found.groupBy("chunk").agg(F.countDistinct("file").alias("n")).agg(F.max("n")).first()[0] <= 5
    assert sorted(r.id for r in found.collect()) == list(range(6000))


def test_chunks_are_staged_once_or_twice(spark, tmp_path):
    rows = spark.range(1200).select("id", F.pmod(hash60("id"), F.lit(12)).cast("int").alias("chunk"))
    path, staging = str(tmp_path / "in"), tmp_path / "staging"
    jobs.write_chunks(rows, path, 50)
    manifest = rows.groupBy("chunk").agg(F.count("*").alias("rows"))
    found = jobs.per_complete_chunk(jobs.file_stream(spark, path, rows.schema, files_per_trigger=4), manifest,
                                    lambda c: c.groupBy("chunk").agg(F.sum("id").alias("total")), "chunk int, total long", "t", staging=str(staging))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in rows.groupBy("chunk").agg(F.sum("id")).collect()}
    batches = len(list(staging.glob("epoch=*")))
    assert batches > 4 and len(list(staging.glob("epoch=*/chunk=*"))) <= 12 * 4 < 12 * batches
