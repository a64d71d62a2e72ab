"""The domain tables, derived from the given tables by projections.

Two ensembles of five replicas: ensemble "e0" or "e1" by the label's parity, replica half the label.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.functions.columns import number_density, packing_fraction

FRAMES = 21


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str, frames: int = FRAMES) -> DataFrame:
    """One row per particle and state: x, y, and the axis angle t."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("k"))
    e = lambda n: F.get("embedding", F.col("k") * 3 + n).cast("double")
    t = 10 * e(2)
    return rows.select(
        F.concat(F.lit("e"), F.col("label") % 2).alias("ensemble_id"), F.floor(F.col("label") / 2).cast("int").alias("replica"), F.col("k").alias("idx"),
        F.col("vec_id").alias("pid"), (40 * e(0)).alias("x"), (40 * e(1)).alias("y"), (t - math.pi * F.floor(t / math.pi)).alias("t"),
    )


def with_state_columns(states: DataFrame) -> DataFrame:
    """Adds gamma, rho and phi."""
    states = states.withColumn("gamma", F.when(F.col("ensemble_id") == "e0", 1.2).otherwise(1.7))
    return states.withColumn("rho", number_density("n", "a", "b")).withColumn("phi", packing_fraction("rho", "gamma"))


def states(spark: SparkSession, sf_dir: str, frames: int = FRAMES) -> DataFrame:
    """One row per state: particle number, box axes, ring radius, gamma, density and packing fraction."""
    rows = particles(spark, sf_dir, frames).groupBy(*KEY).agg(
        F.count("*").alias("n"), (F.max(F.abs("x")) + 2).alias("a"), (F.max(F.abs("y")) + 2).alias("b"), (F.sqrt(F.max(F.col("x") * F.col("x") + F.col("y") * F.col("y"))) + 2).alias("ring_r")
    )
    return with_state_columns(rows)


def ring(states_: DataFrame, points: int = 24) -> DataFrame:
    """Points on a circle around each state, with negative ids."""
    rows = states_.select(*KEY, "ring_r", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    angle = 2 * math.pi * F.col("g") / points + 0.01
    return rows.select(*KEY, (-1 - F.col("g")).cast("long").alias("pid"), (F.col("ring_r") * F.cos(angle)).alias("x"), (F.col("ring_r") * F.sin(angle)).alias("y"))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series from events: ensemble, replica, idx (quarters of a day), x, y."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("ensemble_id"), (F.col("user_id") % 5).cast("int").alias("replica"), F.floor(seconds / 21600).cast("int").alias("idx"), "value")
    return rows.groupBy("ensemble_id", "replica", "idx").agg(F.avg("value").alias("y")).withColumn("x", F.col("idx").cast("double"))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-state properties from line items, in runs of a supplier and line number."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ensemble_id"), F.col("l_linenumber").alias("replica"), (F.row_number().over(order) - 1).alias("idx"),
        F.col("l_extendedprice").alias("max_gradient"), F.col("l_discount").alias("energy"), F.col("l_tax").alias("mean_gradient"), F.col("l_quantity").alias("n"),
    )


def simulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of simulations, from parts: an id, a size, a brand and a price that stand for integer, string and float parameters."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("n"), F.col("p_brand").alias("potential"), F.col("p_retailprice").cast("double").alias("phi0"))
