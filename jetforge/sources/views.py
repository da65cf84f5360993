"""Jet-shaped views over the supplied star-schema tables.

lineitem rows act as constituents, orders as jets, customers as events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def constituents(spark: SparkSession, sf_dir: str, *, by_jet: bool = False) -> DataFrame:
    """``by_jet`` is for several passes by jet: a merge join, also where the orders could be broadcast,
    leaves the rows partitioned by jet, and passes that read the same columns share its shuffle."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.hint("merge") if by_jet else orders
    signal = F.col("l_returnflag") == "R"
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("event_id"),
        F.col("l_orderkey").alias("jet_id"),
        F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"),
        F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice") / 1000).alias("pt"),
        ((F.col("l_partkey") % 1801).cast("double") / 1000 - F.lit(0.9)).alias("eta"),
        (((F.col("l_suppkey") * 97 + F.col("l_linenumber") * 613) % 6283).cast("double") / 1000).alias("phi"),
        F.when(signal, 1 + F.col("l_suppkey") % 8).otherwise(0).cast("int").alias("user_index"),
        F.when(~signal, 0).when(F.col("l_suppkey") % 4 == 1, 2212).when(F.col("l_suppkey") % 4 == 2, 21)
         .otherwise(1).cast("int").alias("origin_kf"),
        (F.col("o_orderkey") % 5).cast("int").alias("r_idx"),
        (10 * (1 + F.col("o_custkey") % 4)).cast("int").alias("pt_hard_min"),
    )


def basic_jets(constits: DataFrame) -> DataFrame:
    """One row per jet with the sums the event-level jobs need."""
    return constits.groupBy("event_id", "jet_id").agg(
        F.max("pt_hard_min").alias("pt_hard_min"), F.max("r_idx").alias("r_idx"),
        F.sum("pt").alias("p_t"),
        F.count_if(F.col("pt") > 1e-50).alias("n_trk"),
        F.sum(F.when(F.col("user_index") != 0, F.col("pt")).otherwise(0.0)).alias("tru_sum"),
    ).withColumn("area", (10 + F.col("jet_id") % 50).cast("double") / 100)


def jet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jet key of every constituent, from the constituent table alone: where hot jets show."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("jet_id"))


def event_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper bound on jets per event, from the orders table alone."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event_id")).agg(F.count("*").alias("n"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momenta and vertices for the kinematics jobs, derived from the constituents."""
    c = constituents(spark, sf_dir)
    return c.select(
        "event_id", "jet_id", "k1", "k2", "k3", "user_index", "origin_kf",
        (F.col("pt") * F.cos("phi")).alias("px"), (F.col("pt") * F.sin("phi")).alias("py"),
        (F.col("pt") * (F.exp("eta") - F.exp(-F.col("eta"))) / 2).alias("pz"),
        (F.col("k2") % 7).cast("double").alias("vx"), (F.col("k3") % 5).cast("double").alias("vy"),
        F.col("k1").cast("double").alias("vz"),
    )
