"""Sums over pairs by blocks and selection by rank, against plain loops."""

import math
import random
from collections import Counter
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.functions.columns import segment_distance
from rodfield.operators import pairs as P
from rodfield.operators.select import value_at_rank

ROD = "ensemble_id string, replica int, idx int, pid long, x double, y double, t double, gamma double"


@pytest.fixture(scope="module")
def rods():
    random.seed(6)
    return [("e", 0, k, i, random.gauss(0, 3), random.gauss(0, 2), random.uniform(0, math.pi), 1.5 + k) for k, n in enumerate((40, 1, 2, 23)) for i in range(n)]


def grouped(rods):
    by = {}
    for row in rods:
        by.setdefault(row[2], []).append(row)
    return by


@pytest.mark.parametrize("block", [7, 512])
def test_pair_bins_brute_force(spark, monkeypatch, rods, block):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "SLICE", 3)
    got = {}
    for r in P.pair_bins(spark.createDataFrame(rods, ROD), ["x", "y", "t"], P.aligned, 10).collect():
        got.setdefault(r.idx, {})[r.bin] = (r.x, r.y)
    for k, state in grouped(rods).items():
        all_ = [(math.dist(a[4:6], b[4:6]), math.cos(2 * (a[6] - b[6]))) for a, b in combinations_with_replacement(state, 2)]
        low, high = min(r for r, _ in all_), max(r for r, _ in all_)
        if low == high:
            assert k not in got
            continue
        want = {}
        for r, c in all_:
            at = math.floor((r - 1e-6 - low) / ((high - low) / 10))
            if 0 <= at < 10:
                want.setdefault(at, []).append(c)
        assert set(got[k]) == set(want)
        for at, values in want.items():
            assert got[k][at] == pytest.approx((low + (at + 0.5) * (high - low) / 10 + 1e-6, sum(values) / len(values)))


@pytest.mark.parametrize("block", [5, 512])
def test_pair_means_and_correlation_sums(spark, monkeypatch, rods, block):
    monkeypatch.setattr(P, "BLOCK", block)
    df = spark.createDataFrame(rods, ROD)
    got = {r.idx: r for r in P.pair_means(df, ["x", "y", "t", "gamma"], {"far": P.rods, "centre": P.centres}).collect()}
    columns = [F.col(f"{c}_{s}") for s in "ij" for c in ("x", "y", "t")]
    rows = P.all_pairs(df, ["t", "gamma"]).where("pid_i < pid_j")
    want = {r.idx: r for r in rows.groupBy(*KEY).agg(F.count("*").alias("pairs"), F.avg(segment_distance(1 - 1 / F.col("gamma_i"), *columns)).alias("far"), F.avg(P.centre_distance()).alias("centre")).collect()}
    assert {k: r.pairs for k, r in got.items() if r.pairs} == {k: r.pairs for k, r in want.items()} and got[1].far is None
    assert all(tuple(got[k])[4:] == pytest.approx(tuple(r)[4:]) for k, r in want.items())
    shifted = df.withColumns({"u": F.cos("t") + 2, "v": F.abs("x") + 1})
    sums = {r.idx: (r.pairs, r.c) for r in P.correlation_sums(shifted, "u", "v").collect()}
    by_pair = P.pair_correlation(shifted, "u", "v").groupBy("idx").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    assert sums == {r.idx: (r.n, pytest.approx(r.c, abs=1e-9)) for r in by_pair}


def test_a_state_of_pairs_is_dealt_by_blocks(spark, monkeypatch, rods):
    """Every pair once and in order with its own columns, whatever the blocks; the pairs of one state come from several tasks, none of which makes most of them."""
    monkeypatch.setattr(P, "DEALT", 7, raising=False)
    set_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rods, ROD).withColumns({"u": F.cos("t") + 2, "v": F.abs("x") + 1})
        pairs = P.all_pairs(df, ["t"]).withColumn("task", F.spark_partition_id()).collect()
        products = P.pair_correlation(df, "u", "v").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    at = {(r[2], r[3]): r for r in rods}
    want = {(k, a[3], b[3]) for k, state in grouped(rods).items() for a, b in combinations_with_replacement(sorted(state), 2)}
    for rows in (pairs, products):
        assert len(rows) == len(want) and {(r.idx, r.pid_i, r.pid_j) for r in rows} == want
        tasks = Counter(r.task for r in rows if r.idx == 0)
        assert len(tasks) > 3 and max(tasks.values()) < 0.5 * sum(tasks.values())
    assert all((r.x_i, r.y_i, r.t_i, r.x_j, r.y_j, r.t_j) == at[r.idx, r.pid_i][4:7] + at[r.idx, r.pid_j][4:7] for r in pairs)
    mean = {k: [sum(f(r) for r in state) / len(state) for f in (lambda r: math.cos(r[6]) + 2, lambda r: abs(r[4]) + 1)] for k, state in grouped(rods).items()}
    for r in products:
        (a, b), (mu, mv) = (at[r.idx, p] for p in (r.pid_i, r.pid_j)), mean[r.idx]
        du, dv = ([f(p) - m for p in (a, b)] for f, m in ((lambda p: math.cos(p[6]) + 2, mu), (lambda p: abs(p[4]) + 1, mv)))
        assert (r.r, r.c) == (pytest.approx(math.dist(a[4:6], b[4:6])), pytest.approx(0.5 / (mu * mv) * (du[0] * dv[1] + du[1] * dv[0]), abs=1e-12))


def test_value_at_rank(spark):
    random.seed(9)
    groups = {0: [random.choice([1.0, 2.5, 2.5, -3.0]) for _ in range(50)], 1: [random.gauss(0, 1) ** 9 for _ in range(80)], 2: [7.0], 3: [5.0] * 30, 4: [None, 1e300, -1e300, 0.0]}
    for levels, bins in ((0, 4), (1, 2), (3, 4)):
        for k in (0, 13, 29):
            rows = [("e", 0, g, v, k) for g, values in groups.items() for v in values]
            got = {r.idx: r.at_rank for r in value_at_rank(spark.createDataFrame(rows, "ensemble_id string, replica int, idx int, v double, k int"), "v", "k", levels=levels, bins=bins).collect()}
            assert got == {g: sorted(v for v in values if v is not None)[k] for g, values in groups.items() if sum(v is not None for v in values) > k}
