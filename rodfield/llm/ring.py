"""The next row in the order of a key, without one task that sorts everything.

Rows are dealt to ranges of the key: 64 quantiles from a sketch, each divided evenly into 32. A window inside each
range gives the next row; the last row of a range takes the first row of the next range, from a table of at most one
row a range (its size is fixed by these two numbers, whatever the input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE, FINE = 64, 32


def range_of(df: DataFrame, key: str) -> Column:
    """A number that never falls as the key rises; null keys get -1. Bounds are found in one pass over the key alone."""
    bounds = sorted(set(df.select(F.col(key).cast("double").alias(key)).approxQuantile(key, [i / COARSE for i in range(COARSE + 1)], 0.25 / COARSE)))
    if len(bounds) < 2:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    at = F.array(*map(F.lit, bounds))
    coarse = F.least(F.size(F.filter(at, lambda b: b <= F.col(key).cast("double"))), F.lit(len(bounds) - 1))
    low, high = F.get(at, F.greatest(coarse, F.lit(1)) - 1), F.get(at, F.greatest(coarse, F.lit(1)))
    fine = F.floor((F.col(key).cast("double") - low) / (high - low) * FINE).cast("int")
    return F.when(F.col(key).isNull(), -1).otherwise(F.greatest(coarse, F.lit(1)) * FINE + F.least(F.greatest(fine, F.lit(0)), F.lit(FINE - 1))).cast("int")


def with_next(df: DataFrame, key: str, tie: str, columns: list[str], bucket: str) -> DataFrame:
    """Adds ``next``, the struct of ``columns`` of the next row by descending key (nulls last; equal keys by the tie
    column); after the last row comes the first. ``bucket``: a column made by :func:`range_of`."""
    order = [F.col(key).desc_nulls_last(), F.col(tie).asc_nulls_last()]
    inside = Window.partitionBy(bucket).orderBy(*order)
    rows = df.withColumn("__next", F.lead(F.struct(*columns)).over(inside)).withColumn("__rank", F.row_number().over(inside))
    firsts = rows.where("__rank = 1").select(F.col(bucket).alias("__bucket"), F.struct(*columns).alias("__first"))
    down = Window.orderBy(F.col("__bucket").desc())
    edges = firsts.select(
        "__bucket",
        F.coalesce(F.lead("__first").over(down), F.first("__first").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__edge"),
    )
    return rows.join(edges, rows[bucket] == edges["__bucket"]).withColumn("next", F.coalesce("__next", "__edge")).drop("__next", "__rank", "__bucket", "__edge")
