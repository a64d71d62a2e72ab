"""Series and curves: (ensemble_id, replica, idx) with columns x and y, one row per point.

A window over a series is partitioned by it, so work spreads over series; a series is at most some thousand points long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodfield.config import SIM


def _order():
    return Window.partitionBy(*SIM).orderBy("idx")


def _whole():
    return Window.partitionBy(*SIM)


def relative_to_first(df: DataFrame, value: str = "y") -> DataFrame:
    """Adds ``relative``: the value over the series' first one; null where that is zero."""
    return df.withColumn("relative", F.try_divide(F.col(value), F.first(value).over(_order())))


def downsample(df: DataFrame, length: int, value: str = "y") -> DataFrame:
    """Each series in ``length`` rows (``k`` from 0): with twice as many points or more every (n div length)-th is taken,
    of what is left the last ``length``; shorter series end with nulls."""
    rows = df.withColumn("__p", F.row_number().over(_order()) - 1).withColumn("__n", F.count("*").over(_whole()))
    # one pass leaves fewer than 2 * length points
    rows = rows.withColumn("__s", F.when(F.col("__n") >= 2 * length, F.floor(F.col("__n") / length)).otherwise(1))
    kept = rows.where(F.col("__p") % F.col("__s") == 0)
    k = F.floor(F.col("__p") / F.col("__s")) - F.greatest(F.ceil(F.col("__n") / F.col("__s")) - length, F.lit(0))
    kept = kept.select(*SIM, k.cast("int").alias("k"), F.col(value).alias("value")).where("k >= 0")
    slots = df.select(*SIM).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return slots.join(kept, [*SIM, "k"], "left")


def plateau(df: DataFrame, value: str = "y", least: float = 1e-3, slope: float = 1e-6, stride: int = 100, occurrence: int = 10) -> DataFrame:
    """Per series the first index at which the value has been flat ``occurrence`` times in a row, null if it never was.
    Flat: under ``least``, or fallen by less than slope * stride in relation to stride - 1 steps before."""
    v, before = F.col(value), F.lag(value, stride - 1).over(_order())
    rows = df.withColumn("__h", F.coalesce(((v < least) | (1 - F.try_divide(v, before) < slope * stride)), F.lit(False)).cast("int"))
    last = _order().rowsBetween(1 - occurrence, 0)
    return rows.withColumn("__r", F.sum("__h").over(last)).groupBy(*SIM).agg(F.min(F.when(F.col("__r") == occurrence, F.col("idx"))).alias("at"))


def suffix_regression(df: DataFrame) -> DataFrame:
    """Line through the last k points, k = 2 .. n - 1: slope, intercept, r2. Running sums from the end: linear in length."""
    back = Window.partitionBy(*SIM).orderBy(F.desc("idx"))
    run = back.rowsBetween(Window.unboundedPreceding, 0)
    fits = {name: f("y", "x").over(run) for name, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))}
    rows = df.withColumns({"k": F.row_number().over(back), "__n": F.count("*").over(_whole()), **fits})
    return rows.where("k >= 2 and k < __n").drop("__n")


def log_suffix_regression(df: DataFrame) -> DataFrame:
    """The same of ln y on ln(x - x0), where x0 is the point before the suffix; k = 2 .. n - 1. Points at or before x0 and
    values that are not positive are left out."""
    back = Window.partitionBy(*SIM).orderBy(F.desc("idx"))
    rows = df.withColumn("k", F.row_number().over(back) - 1)
    base = rows.where("k >= 2").select(*SIM, F.col("k"), F.col("idx").alias("base"), F.col("x").alias("x0"))
    met = base.join(rows.select(*SIM, "idx", "x", "y"), SIM).where("idx > base and x > x0 and y > 0")
    a, b = F.ln("y"), F.ln(F.col("x") - F.col("x0"))
    return met.groupBy(*SIM, "k").agg(F.first("base").alias("base"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))


def critical_point(df: DataFrame, level: float = 0.9999) -> DataFrame:
    """The shortest suffix whose line has r2 under the level and meets zero before some point: k, that zero ``xc`` and the
    index of the first point beyond it, ``at``. Series without one are left out."""
    fits = suffix_regression(df).withColumn("xc", F.try_divide(-F.col("intercept"), F.col("slope"))).where(F.col("r2") < level)
    top = df.groupBy(*SIM).agg(F.max("x").alias("__top"))
    first = fits.join(top, SIM).where("xc < __top").groupBy(*SIM).agg(F.min("k").alias("k"), F.min_by("xc", "k").alias("xc"))
    return df.select(*SIM, "idx", "x").join(first, SIM).where("x > xc").groupBy(*SIM).agg(F.first("k").alias("k"), F.first("xc").alias("xc"), F.min("idx").alias("at"))


def savgol_table(window: int, order: int) -> list[list[float]]:
    """Row e: weights of a window's points for the fitted polynomial's value at its e-th point."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window is odd and longer than the order")
    powers = np.vander(np.arange(window, dtype=float) - window // 2, order + 1)
    return (powers @ np.linalg.pinv(powers)).tolist()


def savgol(df: DataFrame, window: int, order: int, value: str = "y", by: list[str] = SIM, at: str = "idx") -> DataFrame:
    """Adds ``smooth``, the Savitzky-Golay value; at the ends the outermost window's polynomial. Null in series shorter
    than the window."""
    table = F.array(*[F.array(*map(F.lit, row)) for row in savgol_table(window, order)])
    over = Window.partitionBy(*by).orderBy(at)
    rows = df.withColumn("__p", F.row_number().over(over) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    rows = rows.withColumn("__near", F.collect_list(F.struct(F.col("__p").alias("p"), F.col(value).alias("v"))).over(over.rowsBetween(1 - window, window - 1)))
    start = F.greatest(F.least(F.col("__p") - window // 2, F.col("__n") - window), F.lit(0))
    rows = rows.withColumn("__s", start).withColumn("__w", F.get(table, (F.col("__p") - F.col("__s")).cast("int")))
    used = F.filter("__near", lambda q: (q["p"] >= F.col("__s")) & (q["p"] < F.col("__s") + window))
    parts = F.zip_with(used, "__w", lambda q, w: q["v"] * w)
    total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("smooth", F.when(F.col("__n") >= window, total)).drop("__p", "__n", "__near", "__s", "__w")


def prominent_peak(df: DataFrame, value: str = "y", at: str = "idx") -> DataFrame:
    """Per series the peak of highest prominence: ``peak`` (place; the middle of a flat top), ``height``, ``prominence``.
    Of equal ones the first. Series without an inner peak are left out.

    One pass over the series' maxima and the least value before each, with a stack of the maxima that nothing higher has followed yet."""
    order = Window.partitionBy(*SIM).orderBy("__p")
    rows = df.where(F.col(value).isNotNull()).select(*SIM, F.col(at).alias("__at"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("__p", F.row_number().over(Window.partitionBy(*SIM).orderBy("__at")))
    rows = rows.withColumn("__new", F.coalesce((F.col("v") != F.lag("v").over(order)).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(order))
    run = Window.partitionBy(*SIM, "__run")
    middle = F.row_number().over(run.orderBy("__p")) == F.floor((F.count("*").over(run) + 1) / 2)
    by_run = Window.partitionBy(*SIM).orderBy("__run")
    runs = rows.withColumn("__mid", middle).where("__mid").withColumns({"l": F.lag("v").over(by_run), "r": F.lead("v").over(by_run)})
    # the ends of a series bound prominences, but are no peaks
    runs = runs.withColumn("__top", (F.col("l").isNull() | (F.col("l") < F.col("v"))) & (F.col("r").isNull() | (F.col("r") < F.col("v"))))
    runs = runs.withColumn("__group", F.coalesce(F.sum(F.col("__top").cast("int")).over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.when(F.col("__top") & F.col("l").isNotNull() & F.col("r").isNotNull(), F.col("__at"))
    tops = runs.groupBy(*SIM, "__group").agg(F.max(F.when(F.col("__top"), F.col("v"))).alias("v"), F.max(inner).alias("at"), F.min(F.when(~F.col("__top"), F.col("v"))).alias("low"))
    series = tops.groupBy(*SIM).agg(F.array_sort(F.collect_list(F.struct("__group", "v", "at", "low"))).alias("tops"), F.max("at").alias("__some"))
    place = rows.schema["__at"].dataType.simpleString()
    best = f"struct<prominence:double,before:{place},height:double>"

    def passed(kept, low, popped):
        """The best peak once those popped, the latest first, have something higher on their right, and the least value passed."""
        start = F.struct(kept.alias("best"), low.alias("low"))

        def one(s, e):
            prominence = e["v"] - F.greatest(e["left"], s["low"])
            found = F.when(e["at"].isNotNull(), F.struct(prominence.alias("prominence"), (-e["at"]).alias("before"), e["v"].alias("height")))
            return F.struct(F.greatest(s["best"], found.cast(best)).alias("best"), F.least(s["low"], e["low"]).alias("low"))

        return F.aggregate(F.reverse(popped), start, one)

    def step(s, e):
        v = F.coalesce(e["v"], F.lit(float("inf")))
        done = passed(s["best"], e["low"], F.filter(s["stack"], lambda q: q["v"] < v))
        rest = F.filter(s["stack"], lambda q: q["v"] >= v)
        top = F.try_element_at(rest, F.lit(-1))
        # an equal maximum is no bound: what was least before it counts on
        left = F.when(top["v"] == v, F.least(top["left"], done["low"])).otherwise(done["low"])
        new = F.struct(v.alias("v"), e["at"].alias("at"), done["low"].alias("low"), left.alias("left"))
        return F.struct(F.concat(rest, F.array(new)).alias("stack"), done["best"].alias("best"))

    stack = F.array().cast(f"array<struct<v:double,at:{place},low:double,left:double>>")
    end = F.struct(F.lit(None).cast("long").alias("__group"), F.lit(None).cast("double").alias("v"), F.lit(None).cast(place).alias("at"), F.lit(None).cast("double").alias("low"))
    given = F.concat("tops", F.array(end))
    made = series.where("__some is not null").withColumn("__b", F.aggregate(given, F.struct(stack.alias("stack"), F.lit(None).cast(best).alias("best")), step)["best"])
    return made.select(*SIM, (-F.col("__b.before")).cast(place).alias("peak"), F.col("__b.height").alias("height"), F.col("__b.prominence").alias("prominence"))


def power_fit(df: DataFrame, level: float = 0.9999, window: int = 9, order: int = 2) -> DataFrame:
    """Power law above the turning point. The series ends before its critical point, if it has one; of the growing suffixes'
    logarithmic fits the smoothed r2 is searched for its most prominent peak, whose suffix length ``k`` gives ``turning`` (the point before the
    suffix), ``exponent``, ``factor`` and ``r2``."""
    end = critical_point(df, level).select(*SIM, F.col("at").alias("__end"))
    before = df.join(end, SIM, "left").where(F.col("__end").isNull() | (F.col("idx") < F.col("__end"))).drop("__end")
    fits = log_suffix_regression(before).where("r2 is not null")
    peak = prominent_peak(savgol(fits, window, order, "r2", at="k"), "smooth", "k").select(*SIM, F.col("peak").alias("k"))
    return fits.join(peak, [*SIM, "k"]).select(*SIM, "k", F.col("base").alias("turning"), F.col("slope").alias("exponent"), F.exp("intercept").alias("factor"), "r2")


def truncate_at(df: DataFrame, turning: DataFrame) -> DataFrame:
    """Points of another order parameter up to each series' turning point."""
    return df.join(turning.select(*SIM, "turning"), SIM).where(F.col("idx") <= F.col("turning")).drop("turning")


def cubic_fit(df: DataFrame, by: list[str] = SIM, x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares a x^3 + b x^2 + c x + d with the mean squared error; null where fewer than four different x are."""
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    over = Window.partitionBy(*by)
    rows = clean.withColumn("__s", F.greatest(F.max(F.abs(x)).over(over), F.lit(1e-300))).withColumn("__x", F.col(x) / F.col("__s"))
    power = lambda n: F.lit(1.0) if n == 0 else F.pow("__x", F.lit(float(n)))
    sums = rows.groupBy(*by).agg(
        *[F.sum(power(n)).alias(f"m{n}") for n in range(7)], *[F.sum(power(n) * F.col(y)).alias(f"v{n}") for n in range(4)], F.sum(F.col(y) * F.col(y)).alias("yy"),
        F.first("__s").alias("s"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_distinct(x).alias("points"),
    )
    sums = sums.withColumns({f"a{i}{j}": F.col(f"m{i + j}") for i in range(4) for j in range(4)} | {f"b{i}": F.col(f"v{i}") for i in range(4)})
    # the matrix is positive definite: elimination without exchange of rows is stable
    for p in range(4):
        changed = {}
        for i in range(p + 1, 4):
            f = F.try_divide(F.col(f"a{i}{p}"), F.col(f"a{p}{p}"))
            changed |= {f"a{i}{j}": F.col(f"a{i}{j}") - f * F.col(f"a{p}{j}") for j in range(p, 4)} | {f"b{i}": F.col(f"b{i}") - f * F.col(f"b{p}")}
        sums = sums.withColumns(changed) if changed else sums
    for i in (3, 2, 1, 0):
        rest = sum((F.col(f"a{i}{j}") * F.col(f"q{j}") for j in range(i + 1, 4)), F.lit(0.0))
        sums = sums.withColumn(f"q{i}", F.when(F.col("points") >= 4, F.try_divide(F.col(f"b{i}") - rest, F.col(f"a{i}{i}"))))
    error = F.col("yy") - sum((F.col(f"q{i}") * F.col(f"v{i}") for i in range(4)), F.lit(0.0))
    names = {"a": 3, "b": 2, "c": 1, "d": 0}
    return sums.select(*by, *[(F.col(f"q{n}") / F.pow("s", F.lit(float(n)))).alias(c) for c, n in names.items()], F.greatest(error / F.col("m0"), F.lit(0.0)).alias("mse"), "low", "high")


def cubic_minimum(fits: DataFrame) -> DataFrame:
    """Adds ``x_min``: the cubic's local minimum if it lies within [low, high], else the end with the smaller value (the
    upper one of equal ones); null without a fit."""
    a, b, c, d, low, high = map(F.col, ("a", "b", "c", "d", "low", "high"))
    disc = b * b - 3 * a * c
    root = F.try_divide(-b + F.sqrt(F.when(disc > 1e-6, disc)), 3 * a)
    inner = F.when(F.abs(a) > 1e-6, F.when(6 * a * root + 2 * b > 1e-6, root)).when(b > 1e-6, F.try_divide(-c, 2 * b))
    at = lambda x: ((a * x + b) * x + c) * x + d
    end = F.when(at(low) < at(high), low).otherwise(high)
    return fits.withColumn("__i", inner).withColumn("x_min", F.when(a.isNotNull(), F.when((F.col("__i") >= low) & (F.col("__i") <= high), F.col("__i")).otherwise(end))).drop("__i")


def normalize01(column: str, by: list[str] = SIM) -> Column:
    """A column scaled to [0, 1] over its series; null if it is constant."""
    over = Window.partitionBy(*by)
    low, high = F.min(column).over(over), F.max(column).over(over)
    return F.try_divide(F.col(column) - low, high - low)


def uneven_derivative(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``slope``: second-order difference on an uneven grid, one-sided at the ends."""
    step = lambda c, n: F.lead(c, n).over(_order())
    rows = df.withColumns({"__hb": F.col(x) - F.lag(x).over(_order()), "__hf": step(x, 1) - F.col(x), "__db": F.col(y) - F.lag(y).over(_order()), "__df": step(y, 1) - F.col(y)})
    back, front = F.try_divide(F.col("__db"), F.col("__hb")), F.try_divide(F.col("__df"), F.col("__hf"))
    inner = (back * F.col("__hf") + front * F.col("__hb")) / (F.col("__hb") + F.col("__hf"))
    return rows.withColumn("slope", F.coalesce(inner, back, front)).drop("__hb", "__hf", "__db", "__df")


def at_places(df: DataFrame, places: list[float], x: str = "x", values: tuple[str, ...] = ("y",)) -> DataFrame:
    """Values at given places between two points of each series by linear interpolation; places outside are left out."""
    rows = df.select(*SIM, F.col(x).alias("__a"), F.lead(x).over(_order()).alias("__b"), *values, *[F.lead(v).over(_order()).alias(f"__{v}") for v in values])
    rows = rows.withColumn("place", F.explode(F.array(*map(F.lit, places))))
    last = F.col("__b") == F.max("__b").over(_whole())
    rows = rows.withColumn("__last", last).where((F.col("place") >= F.col("__a")) & ((F.col("place") < F.col("__b")) | (F.col("__last") & (F.col("place") == F.col("__b")))))
    share = F.try_divide(F.col("place") - F.col("__a"), F.col("__b") - F.col("__a"))
    return rows.select(*SIM, "place", *[(F.col(v) + share * (F.col(f"__{v}") - F.col(v))).alias(v) for v in values])


def spline_pieces(df: DataFrame) -> DataFrame:
    """The cubic spline through each series' points, by series and point in order of x: ``k``, the point (x, y) and the next one (x1, y1), null
    after the last, and the second derivatives ``m`` and ``m1`` at both. The third derivative is continuous at the second and the last but one
    point; fewer than four points: the polynomial through them. Of points with equal x the least y counts.

    The second derivatives are two folds over a series' inner points, which eliminate and put back in."""
    order = Window.partitionBy(*SIM).orderBy("x")
    rows = df.groupBy(*SIM, "x").agg(F.min("y").alias("y"))
    rows = rows.withColumns({"__p": F.row_number().over(order) - 1, "__n": F.count("*").over(_whole()), "hb": F.col("x") - F.lag("x").over(order), "hf": F.lead("x").over(order) - F.col("x")})
    rows = rows.withColumns({"sb": (F.col("y") - F.lag("y").over(order)) / F.col("hb"), "sf": (F.lead("y").over(order) - F.col("y")) / F.col("hf")})
    # the outer second derivatives follow from the inner ones
    first, last = F.col("__p") == 1, F.col("__p") == F.col("__n") - 2
    hb, hf = F.col("hb"), F.col("hf")
    low = hb - F.when(last, hf * hf / hb).otherwise(0.0)
    up = hf - F.when(first, hb * hb / hf).otherwise(0.0)
    mid = 2 * (hb + hf) + F.when(first, hb + hb * hb / hf).otherwise(0.0) + F.when(last, hf + hf * hf / hb).otherwise(0.0)
    rows = rows.withColumns({"low": low, "up": up, "mid": mid, "rhs": 6 * (F.col("sf") - F.col("sb"))})
    series = rows.groupBy(*SIM).agg(F.array_sort(F.collect_list(F.struct("__p", "x", "y", "hb", "hf", "low", "up", "mid", "rhs"))).alias("q")).withColumn("n", F.size("q"))

    def eliminate(done: Column, q: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))
        mid = q["mid"] - F.coalesce(q["low"] * before["c"], F.lit(0.0))
        return F.concat(done, F.array(F.struct((q["up"] / mid).alias("c"), ((q["rhs"] - F.coalesce(q["low"] * before["d"], F.lit(0.0))) / mid).alias("d"))))

    def back(found: Column, e: Column) -> Column:
        later = F.try_element_at(found, F.lit(-1))
        return F.concat(found, F.array(e["d"] - F.coalesce(e["c"] * later, F.lit(0.0))))

    inner = F.slice("q", 2, F.greatest(F.col("n") - 2, F.lit(0)))
    series = series.withColumn("__e", F.when(F.col("n") >= 4, F.aggregate(inner, F.array().cast("array<struct<c:double,d:double>>"), eliminate)))
    series = series.withColumn("__i", F.reverse(F.aggregate(F.reverse("__e"), F.array().cast("array<double>"), back)))
    at = lambda k: F.get("__i", k)
    ends = F.get("q", F.lit(1)), F.get("q", F.col("n") - 2)
    head = at(F.lit(0)) - ends[0]["hb"] / ends[0]["hf"] * (at(F.lit(1)) - at(F.lit(0)))
    tail = at(F.col("n") - 3) + ends[1]["hf"] / ends[1]["hb"] * (at(F.col("n") - 3) - at(F.col("n") - 4))
    # two points: a line; three: a parabola, whose second derivative is one number
    flat = F.when(F.col("n") == 3, ends[0]["rhs"] / (3 * (ends[0]["hb"] + ends[0]["hf"]))).otherwise(0.0)
    series = series.withColumn("__m", F.when(F.col("n") >= 4, F.concat(F.array(head), "__i", F.array(tail))).otherwise(F.array_repeat(flat, F.col("n"))))
    nth = lambda name, k: F.get("q", k)[name]
    piece = lambda q, k: F.struct(k.alias("k"), q["x"].alias("x"), q["y"].alias("y"), nth("x", k + 1).alias("x1"), nth("y", k + 1).alias("y1"), F.get("__m", k).alias("m"), F.get("__m", k + 1).alias("m1"))
    return series.select(*SIM, F.inline(F.transform("q", piece)))


def spline_resample(df: DataFrame, step: float) -> DataFrame:
    """Each series on its ensemble's regular grid over [min x, max x], ends included, with a spacing of about ``step``:
    ``j``, ``x``, ``y``; y is null outside the series' own range. Points without x or y are left out."""
    clean = df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).select(*SIM, "x", "y")
    span = clean.groupBy("ensemble_id").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    span = span.withColumn("__last", F.greatest(F.ceil((F.col("high") - F.col("low")) / step), F.lit(2)).cast("int") - 1)
    rows = spline_pieces(clean).join(span.withColumn("__w", (F.col("high") - F.col("low")) / F.col("__last")), "ensemble_id")
    # a piece takes the places of the grid from its point to the next; the outer ones those beyond, too
    cell = lambda x: F.try_divide(F.col(x) - F.col("low"), F.col("__w"))
    from_ = F.when(F.col("k") == 0, 0).otherwise(F.greatest(F.floor(cell("x")) - 1, F.lit(0)))
    to = F.when(F.col("x1").isNull(), F.col("__last")).otherwise(F.least(F.ceil(cell("x1")) + 1, F.col("__last")))
    rows = rows.withColumn("j", F.explode(F.sequence(from_.cast("int"), to.cast("int"))))
    rows = rows.withColumn("__g", F.when(F.col("j") == F.col("__last"), F.col("high")).otherwise(F.col("low") + F.col("j") * F.col("__w")))
    g, h = F.col("__g"), F.col("x1") - F.col("x")
    rows = rows.where(((F.col("k") == 0) | (g >= F.col("x"))) & (F.col("x1").isNull() | (g < F.col("x1"))))
    u, v = g - F.col("x"), F.col("x1") - g
    curve = (F.col("m") * v * v * v + F.col("m1") * u * u * u) / (6 * h) + (F.col("y") / h - F.col("m") * h / 6) * v + (F.col("y1") / h - F.col("m1") * h / 6) * u
    y = F.when(g < F.col("x"), None).when(F.col("x1").isNotNull(), curve).when(g == F.col("x"), F.col("y"))
    return rows.select(*SIM, "j", g.alias("x"), y.alias("y"))
