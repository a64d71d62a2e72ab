"""Closed-form checks of what SQL does not compare: splines, ellipse points, odd series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rodfield.operators import aggregate as A
from rodfield.operators import series as S
from rodfield.operators import structure as G
from rodfield.sources import store


def series(spark, ys, name="s", replica=0):
    return spark.createDataFrame([(name, replica, i, float(i), y) for i, y in enumerate(ys)], "ensemble_id string, replica int, idx int, x double, y double")


def points(spark, made):
    """Series from {name: (x, y)}; each its own ensemble."""
    rows = [(name, 0, i, float(a), float(b)) for name, (xs, ys) in made.items() for i, (a, b) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "ensemble_id string, replica int, idx int, x double, y double")


def on_grid(spark, made, step):
    found = S.spline_resample(points(spark, made), step).orderBy("ensemble_id", "j").toPandas()
    return {name: part[["x", "y"]].to_numpy(dtype=float).T for name, part in found.groupby("ensemble_id")}


def test_spline_reproduces_cubics(spark):
    x = np.array([0.0, 0.7, 1.5, 3.0, 3.4, 5.0])
    f = lambda t: t**3 - 2 * t**2 + 0.5 * t + 3
    made = {"cubic": (x, f(x)), "four": (x[:4], f(x[:4])), "three": (x[:3], x[:3] ** 2), "two": (x[:2], x[:2] * 2), "one": (x[2:3], [4.0])}
    found = on_grid(spark, made, 0.21)
    assert len(found["cubic"][0]) == 24 and found["cubic"][0][[0, -1]].tolist() == [0.0, 5.0]
    for name, g in (("cubic", f), ("four", f), ("three", np.square), ("two", lambda t: 2 * t)):
        assert np.allclose(found[name][1], g(found[name][0]), atol=1e-10), name
    assert found["one"].tolist() == [[1.5, 1.5], [4.0, 4.0]]


def dense_spline(x, y, at):
    """Cubics of all pieces as one system: values, equal first and second derivatives, equal third ones at the outer inner points."""
    n = len(x) - 1
    rows, rhs = [], []

    def row(p, t, order, sign=1.0):
        """The derivative of piece p at x[t]."""
        r, u = np.zeros(4 * n), x[t] - x[p]
        for e in range(order, 4):
            r[4 * p + e] = sign * np.prod(np.arange(e - order + 1, e + 1)) * u ** (e - order)
        return r

    for p in range(n):
        rows += [row(p, p, 0), row(p, p + 1, 0)]
        rhs += [y[p], y[p + 1]]
    for p in range(n - 1):
        rows += [row(p, p + 1, d) + row(p + 1, p + 1, d, -1.0) for d in (1, 2)]
        rhs += [0.0, 0.0]
    for p in (0, n - 2):
        rows.append(row(p, p + 1, 3) + row(p + 1, p + 1, 3, -1.0))
        rhs.append(0.0)
    c = np.linalg.solve(np.array(rows), np.array(rhs)).reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    return sum(c[k, e] * (at - x[k]) ** e for e in range(4))


def test_splines_by_a_dense_system(spark):
    rng = np.random.default_rng(4)
    made = {f"s{n}": (np.cumsum(rng.uniform(0.2, 3, n)), rng.normal(0, 5, n)) for n in (4, 5, 6, 9, 40)}
    for name, (g, y) in on_grid(spark, made, 0.37).items():
        assert np.allclose(y, dense_spline(*made[name], g), atol=1e-7), name


def test_splines_of_odd_series(spark):
    """Null outside a series' own range; points without x or y count as absent; of points with equal x the least y counts; order is of no account."""
    rows = [("e", 0, float(i), float(i * i)) for i in (3, 0, 1, 4, 2)] + [("e", 1, 1.0, 5.0), ("e", 1, 2.0, 7.0), ("e", 1, 2.0, 9.0), ("e", 1, None, 1.0), ("e", 1, 3.0, None), ("e", 1, float("nan"), 1.0), ("e", 2, None, None)]
    df = spark.createDataFrame([(e, r, 0, x, y) for e, r, x, y in rows], "ensemble_id string, replica int, idx int, x double, y double")
    found = {(r.replica, r.j): (r.x, r.y) for r in S.spline_resample(df, 0.8).collect()}
    assert [found[0, j] for j in range(5)] == [(float(j), pytest.approx(j * j, abs=1e-12)) for j in range(5)]
    assert [found[1, j][1] for j in range(5)] == [None, 5.0, 7.0, None, None] and len(found) == 10


def test_ellipse_points_have_equal_arcs(spark):
    rows = spark.createDataFrame([("e", 0, 0, 9.0, 4.0, 1.0), ("e", 0, 1, 3.0, 7.0, 1.0), ("e", 0, 2, 5.0, 5.0, 1.0)], "ensemble_id string, replica int, idx int, a double, b double, gamma double")
    points = G.ellipse_points(rows, 0.1).toPandas()
    for (idx, a, b) in ((0, 10, 5), (1, 4, 8), (2, 6, 6)):
        p = points[points.idx == idx].sort_values("g")[["x", "y"]].to_numpy()
        assert np.allclose(p[:, 0] ** 2 / a**2 + p[:, 1] ** 2 / b**2, 1)
        gaps = np.hypot(*(np.roll(p, -1, 0) - p).T)
        assert abs(gaps[:-1].mean() - 0.1) < 1e-3 and gaps[:-1].std() < 2e-3


def test_line_with_a_kink_and_short_series(spark):
    line = series(spark, [3.0 * i + 2 for i in range(12)])
    fits = S.suffix_regression(line).agg(F.min("r2"), F.max("slope")).first()
    assert fits[0] == pytest.approx(1) and fits[1] == pytest.approx(3)
    assert S.critical_point(line).count() == 0
    short = series(spark, [1.0, 2.0])
    assert S.savgol(short, 5, 2).where("smooth is not null").count() == 0
    assert S.prominent_peak(short).count() == 0 and S.cubic_fit(short).first()["a"] is None
    assert [r.value for r in S.downsample(short, 4).orderBy("k").collect()] == [1.0, 2.0, None, None]


def test_flat_top_peaks_at_its_middle(spark):
    row = S.prominent_peak(series(spark, [0.0, 1.0, 5.0, 5.0, 5.0, 2.0, 3.0, 1.0])).first()
    assert (row.peak, row.height, row.prominence) == (3, 5.0, 4.0)


def test_cubic_and_its_minimum(spark):
    row = S.cubic_minimum(S.cubic_fit(series(spark, [(i - 4.0) ** 2 * (i + 6) for i in range(10)]))).first()
    assert (row.a, row.b) == (pytest.approx(1), pytest.approx(-2)) and row.x_min == pytest.approx(4) and row.mse < 1e-6


def test_empty_series(spark):
    none = series(spark, [1.0]).where("false")
    for made in (S.downsample(none, 3), S.plateau(none), S.suffix_regression(none), S.power_fit(none), S.spline_resample(none, 1.0)):
        assert made.count() == 0


def test_replica_names():
    assert store.replica_name("run_a_12.parquet") == ("run_a", 12) and store.replica_name("run.parquet") is None


def plain_peak(ys):
    """Prominence by looking left and right from every flat top."""
    best = None
    i = 0
    while i < len(ys):
        j = i
        while j + 1 < len(ys) and ys[j + 1] == ys[i]:
            j += 1
        if 0 < i and j < len(ys) - 1 and ys[i - 1] < ys[i] > ys[j + 1]:
            sides = []
            for side in (ys[:i][::-1], ys[j + 1 :]):
                low = ys[i]
                for v in side:
                    if v > ys[i]:
                        break
                    low = min(low, v)
                sides.append(low)
            found = (ys[i] - max(sides), -((i + j) // 2))
            best = max(best, found) if best else found
        i = j + 1
    return best and (-best[1], best[0])


@pytest.mark.parametrize("seed", range(3))
def test_peak_by_plain_loops(spark, seed):
    rng = np.random.default_rng(seed)
    made = {f"s{n}": [float(v) for v in rng.integers(-4, 3 + 4 * (n % 3), int(rng.integers(0, 40)))] for n in range(60)}
    made |= {"down": [float(-v) for v in range(500)], "saw": [float((v % 2) * (500 - v)) for v in range(500)], "equal": [0.0, 5.0, 1.0, 5.0, 2.0, 5.0, 0.0], "one": [1.0]}
    rows = [(name, 0, i, float(i), y) for name, ys in made.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "ensemble_id string, replica int, idx int, x double, y double")
    found = {r.ensemble_id: (r.peak, r.prominence) for r in S.prominent_peak(df).collect()}
    assert found == {name: p for name, ys in made.items() if (p := plain_peak(ys))}


def test_circles_by_their_circumference(spark):
    rows = spark.createDataFrame([("e", 0, 0, 1.0), ("e", 0, 1, 0.035), ("e", 0, 2, 0.001)], "ensemble_id string, replica int, idx int, rad double")
    points = G.circle_points(rows, F.col("rad"), 0.1).toPandas()
    assert points.groupby("idx").size().to_dict() == {0: 63, 1: 2}  # 62.83 and 2.199; 0.06 rounds to none
    p = points[points.idx == 0].sort_values("g")[["x", "y"]].to_numpy()
    assert np.allclose(np.hypot(*p.T), 1) and np.allclose(np.hypot(*(np.roll(p, -1, 0) - p).T), 2 * np.sin(np.pi / 63)) and np.allclose(p[0], [1, 0])


def test_report_averages_saves_and_leaves_out_empty_ensembles(spark):
    """Two replicas with the first's x; a null value counts as no sample; a run without states, or an ensemble, has no rows."""
    means = spark.createDataFrame([("e", 0, 0, 1.0, None), ("e", 1, 0, 3.0, None), ("e", 0, 1, 5.0, 2.0), ("gone", 0, 0, 9.0, 9.0)], "ensemble_id string, replica int, idx int, p double, q double")
    states = spark.createDataFrame([("e", 0, 0, 0.1), ("e", 1, 0, 0.2), ("e", 0, 1, 0.3), ("empty", 0, 0, 0.4)], "ensemble_id string, replica int, idx int, phi double")
    raw = {(r.ensemble_id, r.replica, r.idx, r.op): (r.x, r.value) for r in A.report_curves(means, states, ["p", "q"], "phi").collect()}
    assert raw["e", 1, 0, "p"] == (0.2, 3.0) and raw["e", 0, 1, "q"] == (0.3, 2.0) and {k[0] for k in raw} == {"e"} and len(raw) == 6
    target = store.scratch(spark, "report")
    store.save_results(A.report_curves(means, states, ["p", "q"], "phi", averaged=True), target, "phi")
    found = {(r.idx, r.op): (r.x, r["mean"], r.ci) for r in store.open_results(spark, target).collect()}
    # two samples: the 0.975 quantile of t with one degree of freedom is 12.7062
    assert found[0, "p"] == (0.1, 2.0, pytest.approx(12.7062, abs=1e-3)) and found[1, "p"] == (0.3, 5.0, None)
    assert found[0, "q"] == (0.1, None, None) and found[1, "q"] == (0.3, 2.0, None) and len(found) == 4
    assert {r.op for r in store.stored_orders(spark, target).collect()} == {"p", "q"}
    assert A.report_curves(means.where("false"), states, ["p"], "phi", averaged=True).count() == 0
