"""Results and runs as Parquet: packing files, appending, rewriting, saved curves, lists of inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rodfield.plans.lineage import shared_folder

#: File names of a replica: ensemble, underscore, number.
REPLICA = r"([^/]*?)_(\d+)\.parquet"
#: Beginnings of file names that packing leaves out.
RESERVED = ("_", ".", "analysis")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, which every executor sees."""
    token = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{shared_folder(spark)}/{name}-{token}"


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """All replica files of a folder as one table: the ensemble from the file's name, replicas numbered by the name's number
    in numeric order. Reserved and other names are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder).withColumn("__f", F.regexp_extract(F.col("_metadata.file_path"), r"/(?:run=)?([^/]+)/[^/]*$", 1))
    rows = rows.withColumn("__e", F.regexp_extract("__f", f"^{REPLICA}$", 1)).withColumn("__r", F.regexp_extract("__f", f"^{REPLICA}$", 2))
    kept = rows.where("__e != ''")
    for start in RESERVED:
        kept = kept.where(~F.col("__e").startswith(start))
    # names are few: the ranking takes distinct ones, not rows
    from pyspark.sql import Window

    numbers = kept.select("__e", "__r").distinct().withColumn("__n", F.row_number().over(Window.partitionBy("__e").orderBy(F.col("__r").cast("bigint"))) - 1)
    kept = kept.join(numbers, ["__e", "__r"])
    others = [c for c in rows.columns if c not in ("ensemble_id", "replica", "__f", "__e", "__r")]
    return kept.select(F.col("__e").alias("ensemble_id"), F.col("__n").cast("int").alias("replica"), *others)


def pack(spark: SparkSession, folder: str, target: str) -> None:
    """Replica files as one dataset by ensemble; the target must not exist."""
    read_packed(spark, folder).write.partitionBy("ensemble_id").mode("errorifexists").parquet(target)


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Number and size of a folder's Parquet files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select("length").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def recompress(spark: SparkSession, source: str, target: str, codec: str = "zstd") -> DataFrame:
    """Rewrites a table with another codec; the sizes before and after."""
    spark.read.parquet(source).write.option("compression", codec).mode("errorifexists").parquet(target)
    sized = lambda folder, name: file_sizes(spark, folder).select(F.lit(name).alias("step"), "files", "bytes")
    return sized(source, "before").unionByName(sized(target, "after"))


def append(df: DataFrame, target: str) -> None:
    """Saved states added to a table, which a stream may read."""
    df.write.mode("append").parquet(target)


def save_results(curves: DataFrame, target: str, x_name: str) -> None:
    """Curves, averaged or not, with the name of their x axis, by order parameter (``op``)."""
    curves.withColumn("x_name", F.lit(x_name)).write.partitionBy("op").mode("errorifexists").parquet(target)


def open_results(spark: SparkSession, source: str, op: str | None = None) -> DataFrame:
    """Saved curves, of one order parameter or of all; their names are partitions, so that no other file is read."""
    rows = spark.read.parquet(source).withColumn("op", F.col("op").cast("string"))
    return rows.where(F.col("op") == op) if op is not None else rows


def stored_orders(spark: SparkSession, source: str) -> DataFrame:
    """The order parameters that a stored result holds: ``op`` and the name of its x axis."""
    return open_results(spark, source).select("op", "x_name").distinct()


def stored_series(results: DataFrame) -> DataFrame:
    """Per ensemble and order parameter the series' number of points and the range of x."""
    return results.groupBy("ensemble_id", "op").agg(F.count("*").alias("points"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, trimmed, without blank ones: ``name``."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where(F.length("name") > 0)


def write_replicas(df: DataFrame, folder: str) -> None:
    """One folder of files per replica, named ensemble_number.parquet, as simulations leave them."""
    named = df.withColumn("run", F.concat_ws("", F.col("ensemble_id"), F.lit("_"), F.col("replica"), F.lit(".parquet")))
    named.drop("ensemble_id", "replica").repartition("run").write.partitionBy("run").parquet(folder)


def replica_name(name: str) -> tuple[str, int] | None:
    """Ensemble and number of a file's name."""
    found = re.fullmatch(REPLICA, name)
    return (found[1], int(found[2])) if found else None
