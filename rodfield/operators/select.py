"""Selection, intervals, masks and parameter tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rodfield.config import KEY, PHI_0, PHI_C, SIM
from rodfield.functions.columns import reference_phi


def find(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the given values; floats match within 1e-6, all else exactly."""
    for name, value in wanted.items():
        near = isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType)
        df = df.where(F.abs(F.col(name) - F.lit(value)) < 1e-6 if near else F.col(name) == F.lit(value))
    return df


def ensemble_summary(states: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ensemble with its parameters and number of states, sorted by gamma."""
    return states.groupBy("ensemble_id").agg(*[F.first(c, True).alias(c) for c in columns], (F.max("idx") + 1).alias("n_states")).orderBy("gamma")


def at_index(df: DataFrame, k: int, order: str = "idx", by: list[str] = SIM) -> DataFrame:
    """The k-th row of each series; negative numbers count from the end."""
    column = F.col(order).asc() if k >= 0 else F.col(order).desc()
    place = k + 1 if k >= 0 else -k
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(column))).where(F.col("__at") == place).drop("__at")


def index_interval(states: DataFrame, phi_c: float | None = None, upper_h: float | None = None, upper_phi: float | None = None) -> DataFrame:
    """States from the first with phi > phi_c to before the first with phi over the upper bound, given as h or phi."""
    if upper_h is not None and upper_phi is not None:
        raise ValueError("the upper bound is given as h or as phi, not both")
    over = Window.partitionBy(*SIM)
    low = F.min(F.when(F.col("phi") > phi_c, F.col("idx"))).over(over) if phi_c is not None else F.lit(0)
    rows = states.withColumn("__low", low)
    if upper_h is not None or upper_phi is not None:
        bound = reference_phi("gamma", upper_h) if upper_h is not None else F.lit(upper_phi)
        rows = rows.withColumn("__high", F.min(F.when(F.col("phi") > bound, F.col("idx"))).over(over))
        rows = rows.where(F.col("__high").isNull() | (F.col("idx") < F.col("__high"))).drop("__high")
    return rows.where(F.col("idx") >= F.col("__low")).drop("__low")


def parameter_grid(spark, **lists) -> DataFrame:
    """Cartesian product of named lists of parameters."""
    made = spark.range(1)
    for name, values in lists.items():
        made = made.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return made.drop("id")


def group_similar(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Adds ``group``, equal for rows whose parameters agree (floats to 9 digits, NaN equal to NaN, null to null)."""
    parts = []
    for c in columns:
        double = isinstance(df.schema[c].dataType, T.DoubleType | T.FloatType)
        parts.append((F.when(F.isnan(c), F.lit("nan")).otherwise(F.round(c, 9).cast("string")) if double else F.col(c).cast("string")).alias(f"__{c}"))
    names = [f"__{c}" for c in columns]
    keyed = df.select("*", *parts)
    groups = keyed.groupBy(*names).agg(F.min(key).alias("group"))
    joined = keyed.alias("k").join(groups.alias("g"), [F.col(f"k.{n}").eqNullSafe(F.col(f"g.{n}")) for n in names])
    return joined.select(*[F.col(f"k.{c}") for c in df.columns], F.col("g.group"))


def renumber_replicas(df: DataFrame, by: list[str], sources: list[str]) -> DataFrame:
    """Replicas of several runs of one ensemble numbered anew, in the order of their sources."""
    return df.withColumn("replica", F.dense_rank().over(Window.partitionBy(*by).orderBy(*sources)) - 1)


def truncate_common(df: DataFrame) -> DataFrame:
    """Every replica of an ensemble cut to the length of the shortest."""
    ends = df.groupBy("ensemble_id", "replica").agg(F.max("idx").alias("__end")).groupBy("ensemble_id").agg(F.min("__end").alias("__end"))
    return df.join(ends, "ensemble_id").where(F.col("idx") <= F.col("__end")).drop("__end")


def clean_prefix(df: DataFrame, value: str, by: list[str] = SIM, order: str = "idx") -> DataFrame:
    """Rows before the first null or NaN value of each series."""
    bad = F.col(value).isNull() | F.isnan(F.col(value).cast("double"))
    first = F.min(F.when(bad, F.col(order))).over(Window.partitionBy(*by))
    return df.withColumn("__bad", first).where(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")


def first_bad(df: DataFrame, value: str, by: list[str] = SIM, order: str = "idx") -> DataFrame:
    """The first position of a null or NaN value in each series, null if there is none."""
    return df.groupBy(*by).agg(F.min(F.when(F.col(value).isNull() | F.isnan(F.col(value).cast("double")), F.col(order))).alias("first_bad"))


def worst_states(df: DataFrame, value: str, by: str = "ensemble_id", size: str | None = None, power: float = 0.0) -> DataFrame:
    """Per ensemble the largest value, scaled by size^-power, with its replica and index."""
    scaled = F.col(value) * F.pow(F.col(size), F.lit(-power)) if size else F.col(value)
    rows = df.withColumn("__v", scaled).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    best = F.max_by(F.struct("replica", "idx"), F.struct("__v", -F.col("replica"), -F.col("idx")))
    return rows.groupBy(by).agg(F.max("__v").alias("value"), best.alias("at")).select(by, "value", "at.replica", "at.idx")


# masks


def inner_ellipse(phi: str = "phi") -> Column:
    """Inside an ellipse that narrows as the packing fraction nears the critical one."""
    ratio = (PHI_C - F.col(phi)) / (PHI_C - PHI_0)
    y = F.col("b") * ratio
    return F.when(ratio <= 0, False).otherwise(F.coalesce(F.col("x") * F.col("x") / (F.col("a") * F.col("a")) + F.try_divide(F.col("y") * F.col("y"), y * y) < 1, F.lit(False)))


def internal_window() -> Column:
    """Outside the band between 2/3 and 5/6 of the height, in the middle half of the width."""
    y, b = F.abs("y"), F.col("b")
    return ~((y > 2 * b / 3) & (y < 5 * b / 6) & (F.abs("x") < F.col("a") / 2))


def mask_expression(expression: str, masks: dict[str, Column]) -> Column:
    """A boolean column from names, ~, &, | and parentheses; an unknown name is an error."""
    names = re.findall(r"[A-Za-z_][A-Za-z_0-9]*", expression)
    if unknown := set(names) - set(masks):
        raise ValueError(f"unknown masks: {sorted(unknown)}")
    rest = re.sub(r"[A-Za-z_][A-Za-z_0-9]*|[~&|()\s]", "", expression)
    if rest or not names:
        raise ValueError(f"not a mask expression: {expression!r}")
    tokens = re.findall(r"[A-Za-z_][A-Za-z_0-9]*|[~&|()]", expression)

    def either() -> Column:
        found = both()
        while tokens and tokens[0] == "|":
            tokens.pop(0)
            found = found | both()
        return found

    def both() -> Column:
        found = one()
        while tokens and tokens[0] == "&":
            tokens.pop(0)
            found = found & one()
        return found

    def one() -> Column:
        if not tokens:
            raise ValueError(f"not a mask expression: {expression!r}")
        token = tokens.pop(0)
        if token == "~":
            return ~one()
        if token == "(":
            found = either()
            if not tokens or tokens.pop(0) != ")":
                raise ValueError(f"not a mask expression: {expression!r}")
            return found
        if token not in masks:
            raise ValueError(f"not a mask expression: {expression!r}")
        return masks[token]

    found = either()
    if tokens:
        raise ValueError(f"not a mask expression: {expression!r}")
    return found


def zero_masked(value: str | Column, mask: Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(mask, value).otherwise(0.0)


def null_masked(value: str | Column, mask: Column, reverse: bool = False) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~mask if reverse else mask, value)


def value_at_rank(rows: DataFrame, value: str, rank: str, by: list[str] = KEY, levels: int = 2, bins: int = 1024) -> DataFrame:
    """Per group the value at a rank (from 0, ascending) as ``at_rank``, by selection: values are counted in bins over the group's range, only the bin that the rank falls
    in is kept, and so once more; the values left are counted as they are. No group is sorted. Null values are left out."""
    now = rows.select(*by, F.col(value).cast("double").alias("__v"), F.col(rank).cast("long").alias("__k")).where("__v is not null")
    for _ in range(levels):
        ends = now.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        bin_ = F.coalesce(F.least(F.floor(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
        binned = now.join(ends, by).withColumn("__bin", bin_).drop("__lo", "__hi")
        counts = binned.groupBy(*by, "__bin").agg(F.count("*").alias("__n"), F.first("__k").alias("__k"))
        upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__bin"))
        kept = counts.withColumn("__upto", upto).where("__upto - __n <= __k and __k < __upto").select(*by, F.col("__bin"), (F.col("__k") - F.col("__upto") + F.col("__n")).alias("__new"))
        now = binned.join(kept, [*by, "__bin"]).select(*by, "__v", F.col("__new").alias("__k"))
    counts = now.groupBy(*by, "__v").agg(F.count("*").alias("__n"), F.first("__k").alias("__k"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__v"))
    return counts.withColumn("__upto", upto).where("__upto - __n <= __k and __k < __upto").select(*by, F.col("__v").alias("at_rank"))


def y_rank_mask(particles: DataFrame, n_inner: Column, scaled: bool = False) -> DataFrame:
    """Adds ``y_rank``: |y| at or above a threshold taken at a rank, half way out to the box. Needs columns a, b and n;
    ``n_inner`` is the rank."""
    rank = F.greatest(F.least(F.bround(n_inner).cast("int"), F.col("n").cast("int") - 1), F.lit(0))
    height = F.try_divide(F.abs("y"), F.sqrt(F.col("a") * F.col("a") - F.col("x") * F.col("x"))) + 0.01 if scaled else F.abs("y")
    rows = particles.withColumns({"__h": height, "__low": -height, "__rank": rank})
    rows = rows.join(value_at_rank(rows, "__low", "__rank").withColumnRenamed("at_rank", "__c"), KEY, "left")
    level = -F.col("__c") if scaled else F.col("b") - 0.5 * (F.col("b") + F.col("__c"))
    return rows.withColumn("y_rank", F.col("__h") >= level).drop("__h", "__low", "__rank", "__c")
