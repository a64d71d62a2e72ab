"""Closed-form fixtures and invariants of the operators, and a few queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rodfield.functions.columns import ellipse_distance, segment_distance
from rodfield.functions.student import t_table
from rodfield.operators import aggregate, delaunay, graph, select
from rodfield.plans import registry

SF = "/root/testdata/sf0.001"


def test_student_table():
    t = t_table()
    assert t[0] == pytest.approx(12.7062, abs=1e-3) and t[9] == pytest.approx(2.22814, abs=1e-4)


def _distance(spark, *row):
    names = ["r", "x1", "y1", "t1", "x2", "y2", "t2"]
    return spark.createDataFrame([tuple(map(float, row))], names).select(segment_distance(*names).alias("d")).first()["d"]


def test_segment_distances(spark):
    assert _distance(spark, 1, 0, 0, 0, 0, 0, math.pi / 2) == 0
    assert _distance(spark, 1, 0, 0, 0, 0, 0.5, 0) == pytest.approx(0.5)
    assert _distance(spark, 1, 0, 0, 0, 0, 1.5, math.pi / 2) == pytest.approx(0.5)


def test_ellipse_distance_on_a_circle(spark):
    row = spark.createDataFrame([(0.3, 0.4, 2.0, 2.0)], "x double, y double, a double, b double").select(ellipse_distance("x", "y", "a", "b").alias("d")).first()
    assert row["d"] == pytest.approx(1.5, abs=1e-2)


@pytest.fixture(scope="module")
def lattice(spark):
    """A hexagonal lattice with a small jitter, all rods parallel."""
    import random

    random.seed(1)
    rows = [("e0", 0, 0, i * 9 + j, j + 0.5 * (i % 2) + random.uniform(-1e-3, 1e-3), i * math.sqrt(3) / 2 + random.uniform(-1e-3, 1e-3), 0.5, 1.5) for i in range(9) for j in range(9)]
    p = spark.createDataFrame(rows, "ensemble_id string, replica int, idx int, pid long, x double, y double, t double, gamma double").persist()
    ring = [("e0", 0, 0, -1 - g, 4.25 + 9 * math.cos(2 * math.pi * g / 24 + 0.01), 3.5 + 9 * math.sin(2 * math.pi * g / 24 + 0.01)) for g in range(24)]
    points = p.select("ensemble_id", "replica", "idx", "pid", "x", "y").unionByName(spark.createDataFrame(ring, "ensemble_id string, replica int, idx int, pid long, x double, y double"))
    triangles = delaunay.triangulate(points).persist()
    return p, triangles


def test_hexagonal_lattice(lattice):
    p, triangles = lattice
    rows = {r["pid"]: r for r in graph.order_parameters(p, delaunay.edges_of(triangles)).collect()}
    inner = [rows[i * 9 + j] for i in range(2, 7) for j in range(2, 7)]
    assert all(r["z"] == 6 and r["Phi6"] > 0.99 and r["S_local"] == pytest.approx(1) for r in inner)
    assert sum(r["z"] for r in rows.values()) == 2 * delaunay.edges_of(triangles).count()


def test_two_particles_have_no_triangles(spark):
    points = spark.createDataFrame([("e0", 0, 0, 0, 0.0, 0.0), ("e0", 0, 0, 1, 1.0, 0.0)], "ensemble_id string, replica int, idx int, pid long, x double, y double")
    assert delaunay.triangulate(points).count() == 0


def test_mask_expressions():
    masks = {"a": F.lit(True), "b": F.lit(False)}
    select.mask_expression("~~a & (b | ~b)", masks)
    for bad in ("a & c", "a +", "(a", "a b", ""):
        with pytest.raises(ValueError):
            select.mask_expression(bad, masks)


def test_one_replica_has_no_interval(spark):
    row = aggregate.replica_mean(spark.createDataFrame([("e", 0, 1.0)], "e string, idx int, v double"), "v", ["e", "idx"]).first()
    assert row["mean"] == 1.0 and row["ci"] is None


@pytest.mark.parametrize("name", ["A1_load_states", "B15_worst_states", "D5_y_rank", "G4_nematic_order_ci", "G9_sweep", "C13_close_pairs", "T1_state_distance"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(registry.oracles()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(str(r) for r in cursor.fetchall())
    got = sorted(str(tuple(r)) for r in registry.queries()[name](spark, SF).select(*columns).collect())
    assert got == want
