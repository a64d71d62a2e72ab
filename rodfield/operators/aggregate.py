"""Aggregation over particles, states, replicas and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.functions.columns import histogram_bin
from rodfield.functions.student import t_quantile


def with_range(df: DataFrame, value: str, by: list[str], low: str, high: str) -> DataFrame:
    """Adds the least and greatest value of each row's group. Groups are summed up before they are shuffled and joined back, so
    that a large group is not one task."""
    span = df.groupBy(*by).agg(F.min(value).alias(low), F.max(value).alias(high))
    return df.join(span, by)


def state_mean(df: DataFrame, columns: list[str], mask: Column | None = None) -> DataFrame:
    """Mean of columns per state, over all or the masked particles; nulls are left out."""
    kept = lambda c: F.when(mask, F.col(c)) if mask is not None else F.col(c)
    return df.groupBy(*KEY).agg(*[F.avg(kept(c)).alias(c) for c in columns])


def to_curves(df: DataFrame, ops: list[str], x: str) -> DataFrame:
    """Wide values per state to one row per order parameter."""
    return df.select(*KEY, F.col(x).alias("x"), F.explode(F.create_map(*[e for op in ops for e in (F.lit(op), F.col(op))])).alias("op", "value"))


def replica_mean(df: DataFrame, value: str, by: list[str], **also: Column) -> DataFrame:
    """Mean over replicas and 95 % radius by Student's t; the radius is null for a single sample. ``also``: further aggregates by name."""
    clean = F.when(~F.isnan(F.col(value)), F.col(value))
    rows = df.groupBy(*by).agg(F.avg(clean).alias("mean"), F.stddev_samp(clean).alias("__s"), F.count(clean).alias("__n"), *[c.alias(n) for n, c in also.items()])
    ci = F.when(F.col("__n") > 1, t_quantile(F.col("__n") - 1) * F.col("__s") / F.sqrt("__n"))
    return rows.withColumn("ci", ci).drop("__s", "__n")


def report_curves(means: DataFrame, states: DataFrame, ops: list[str], x: str, averaged: bool = False) -> DataFrame:
    """A report's curves from means by state: (K, x, op, value), or averaged over replicas (ensemble_id, idx, op, mean, ci, x), x being the
    first replica's. Ensembles without states have no rows; an order parameter that is null in all replicas has a null mean."""
    curves = to_curves(means.join(states.select(*KEY, x), KEY), ops, x)
    return replica_mean(curves, "value", ["ensemble_id", "idx", "op"], x=F.min_by("x", "replica")) if averaged else curves


def band(df: DataFrame) -> DataFrame:
    """Lower and upper ends of the confidence band."""
    return df.withColumns({"low": F.col("mean") - F.col("ci"), "high": F.col("mean") + F.col("ci")})


def sweep(df: DataFrame, value: str, method: str = "average", by: tuple[str, ...] = ("gamma", "idx")) -> DataFrame:
    """Element-wise sum or average of a series over files and replicas."""
    if method not in ("average", "sum"):
        raise ValueError(f"unknown method {method!r}")
    return df.groupBy(*by).agg((F.avg(value) if method == "average" else F.sum(value)).alias(value))


def histogram(df: DataFrame, value: str, low, high, bins: int, by: list[str]) -> DataFrame:
    """Counts per bin."""
    return df.withColumn("bin", histogram_bin(value, low, high, bins)).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("count"))


def distribution(df: DataFrame, value: str, low, high, bins: int, by: list[str]) -> DataFrame:
    """Histogram with a mean of one over all bins."""
    rows = histogram(df, value, low, high, bins, by)
    return rows.withColumn("density", F.col("count") / F.sum("count").over(Window.partitionBy(*by)) * bins)


def log_histogram(df: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """Histogram of log10 of the positive values over each group's own range."""
    rows = df.where(F.col(value) > 0).withColumn("__l", F.log10(value))
    rows = with_range(rows, "__l", by, "__a", "__b")
    return rows.withColumn("bin", histogram_bin("__l", "__a", "__b", bins)).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("count"))


def two_orders(curves: DataFrame, one: str, two: str, by: list[str]) -> DataFrame:
    """Values of two order parameters of the same state side by side."""
    return curves.where(F.col("op").isin(one, two)).groupBy(*by).agg(F.max(F.when(F.col("op") == one, F.col("value"))).alias("first"), F.max(F.when(F.col("op") == two, F.col("value"))).alias("second")).where("first is not null and second is not null")


def boltzmann_average(df: DataFrame, energy: str, columns: list[str], temperature: float, by: list[str]) -> DataFrame:
    """Averages weighted by exp(-(e - min e)/T)."""
    w = F.exp(-(F.col(energy) - F.col("__low")) / temperature)
    return with_range(df, energy, by, "__low", "__high").groupBy(*by).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns])


def ground_state(df: DataFrame, energy: str, order: str, columns: list[str], by: list[str]) -> DataFrame:
    """The state of lowest energy; of equal ones the last."""
    best = F.max_by(F.struct(order, *columns), F.struct(-F.col(energy), F.col(order)))
    return df.where(F.col(energy).isNotNull()).groupBy(*by).agg(best.alias("s")).select(*by, "s.*")


def legality_map(df: DataFrame, flag: str, width: int) -> DataFrame:
    """Replicas by states, 0 or 1, null where a replica has no such state."""
    return df.groupBy("ensemble_id", "replica").pivot("idx", list(range(width))).agg(F.max(F.col(flag).cast("int")))
