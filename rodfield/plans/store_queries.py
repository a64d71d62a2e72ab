"""Queries on stored tables, streams and user functions, each with equivalent SQL where there is one."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.functions import hooks as H
from rodfield.operators import by_name as O
from rodfield.plans.base_queries import BASE, CURVES_SQL, S_GLOBAL_SQL, K, particles_sql, r, rounded
from rodfield.plans.graph_queries import ORDERS_SQL, edges, particles
from rodfield.sources import adapters as A
from rodfield.sources import store as S
from rodfield.streaming import states as W

QUERIES, ORACLES = {}, {}
C = f"WITH {CURVES_SQL}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("A4_pack_files", f"{C} SELECT {K}, round(y, 6) AS y FROM curves")
def a4(spark, d):
    files, packed = S.scratch(spark, "replicas"), S.scratch(spark, "packed")
    S.write_replicas(A.curves(spark, d), files)
    S.pack(spark, files, packed)
    return rounded(spark.read.parquet(packed), "y").select(F.col("ensemble_id").cast("string"), "replica", "idx", "y")


@query("A5_recompress", "SELECT 'before' AS step, count(*) AS n, true AS sized FROM events UNION ALL SELECT 'after', count(*), true FROM events")
def a5(spark, d):
    """Sizes depend on the machine, so the result says only that each is there, with the rows that remain."""
    one, two = S.scratch(spark, "plain"), S.scratch(spark, "packed")
    A.read(spark, d, "events").write.option("compression", "none").parquet(one)
    sizes = S.recompress(spark, one, two)
    count = lambda path, name: spark.read.parquet(path).agg(F.count("*").alias("n")).withColumn("step", F.lit(name))
    return sizes.join(count(one, "before").unionByName(count(two, "after")), "step").select("step", "n", (F.col("bytes") > 0).alias("sized"))


@query("A6_append_states", f"{BASE} SELECT ensemble_id, replica, count(*) AS n_states, max(idx) AS last FROM states GROUP BY 1, 2")
def a6(spark, d):
    target = S.scratch(spark, "states")
    states = A.states(spark, d)
    S.append(states.where("idx < 10"), target)
    S.append(states.where("idx >= 10"), target)
    return spark.read.parquet(target).groupBy("ensemble_id", "replica").agg(F.count("*").alias("n_states"), F.max("idx").alias("last"))


@query("A8_save_results", f"{C} SELECT {K}, x, 'y' AS op, round(y, 6) AS value, 'quarter' AS x_name FROM curves")
def a8(spark, d):
    target = S.scratch(spark, "results")
    S.save_results(A.curves(spark, d).select(*KEY, "x", F.lit("y").alias("op"), F.col("y").alias("value")), target, "quarter")
    return rounded(spark.read.parquet(target), "value").select(*KEY, "x", F.col("op").cast("string"), "value", "x_name")


@query("A12_stored_series", f"{C} SELECT ensemble_id, 'y' AS op, 'quarter' AS x_name, count(*) AS points, min(x) AS x_min, max(x) AS x_max FROM curves GROUP BY 1")
def a12(spark, d):
    target = S.scratch(spark, "results")
    curves = A.curves(spark, d).select(*KEY, "x", F.col("y").alias("value"))
    S.save_results(curves.withColumn("op", F.explode(F.array(F.lit("y"), F.lit("z")))), target, "quarter")
    found = S.stored_series(S.open_results(spark, target, "y"))
    return found.join(S.stored_orders(spark, target), "op").select("ensemble_id", "op", "x_name", "points", "x_min", "x_max")


@query("A9_read_names", "SELECT DISTINCT trim(p_brand) AS name FROM part WHERE length(trim(p_brand)) > 0")
def a9(spark, d):
    target = S.scratch(spark, "names")
    lines = A.read(spark, d, "part").select("p_brand").distinct()
    lines.select(F.explode(F.array(F.concat(F.lit("  "), "p_brand", F.lit(" ")), F.lit("   "))).alias("value")).write.text(target)
    return S.read_names(spark, target)


@query("W1_stream_summaries", "SELECT event_type AS ensemble_id, count(*) AS n_states, min(value) AS low, max(value) AS high, round(sum(value), 2) AS total FROM events GROUP BY 1")
def w1(spark, d):
    source, target, marks = S.scratch(spark, "growing"), S.scratch(spark, "summary"), S.scratch(spark, "marks")
    S.append(A.read(spark, d, "events").select("event_id", "event_type", "value").repartition(4, "event_id"), source)
    stream = W.read(spark, source, spark.read.parquet(source).schema, 2).withColumnRenamed("event_type", "ensemble_id")
    W.keep_table(W.summaries(stream, ["ensemble_id"], "value"), target, marks)
    return rounded(W.kept(spark, target, ["ensemble_id"]), "total", digits=2)


@query("W2_stream_plateaus", f"""{C}, h AS (SELECT *, CAST(coalesce(y < 20 OR 1 - y/nullif(lag(y, 4) OVER w, 0) < 0.05, false) AS INTEGER) AS h FROM curves WINDOW w AS (PARTITION BY ensemble_id, replica ORDER BY idx)),
f AS (SELECT *, sum(h) OVER (PARTITION BY ensemble_id, replica ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r FROM h) SELECT ensemble_id, replica, min(idx) AS at FROM f WHERE r = 5 GROUP BY 1, 2""")
def w2(spark, d):
    source, target, marks = S.scratch(spark, "growing"), S.scratch(spark, "plateaus"), S.scratch(spark, "marks")
    points = A.curves(spark, d).select(*KEY, "y")
    # points arrive as runs save them, a stretch of all series at a time, so that a series goes on over several batches
    last = points.agg(F.max("idx")).first()[0] or 0
    for start in range(0, last + 1, 1 + last // 4):
        S.append(points.where(F.col("idx").between(start, start + last // 4)).repartition(2, "ensemble_id", "replica"), source)
    stream = W.read(spark, source, spark.read.parquet(source).schema, 2)
    W.collect_to(W.plateaus(stream, ["ensemble_id", "replica"], 20.0, 0.01, 5, 5), target, marks)
    return spark.read.parquet(target)


@query("U1_per_ensemble", f"{BASE} SELECT ensemble_id, round(max(phi) - min(phi), 6) AS span FROM states GROUP BY 1")
def u1(spark, d):
    def span(batches):
        name, low, high = None, math.inf, -math.inf
        for t in batches:
            name, low, high = t["ensemble_id"].iloc[0], min(low, t["phi"].min()), max(high, t["phi"].max())
        yield pd.DataFrame({"ensemble_id": [name], "span": [high - low]})

    return rounded(H.per_ensemble_in_batches(A.states(spark, d).select("ensemble_id", "phi"), span, "ensemble_id string, span double"), "span")


@query("U2_per_state", f"WITH {particles_sql()} SELECT {K}, round(median(x), 6) + 0.0 AS middle FROM particles GROUP BY ALL")
def u2(spark, d):
    f = lambda t: t.iloc[:1][KEY].assign(middle=t["x"].median())
    return rounded(H.per_state(A.particles(spark, d).select(*KEY, "x"), f, "ensemble_id string, replica int, idx int, middle double"), "middle")


@query("U3_per_simulation", f"{BASE} SELECT ensemble_id, replica, idx, round(sum(phi) OVER (PARTITION BY ensemble_id, replica ORDER BY idx), 6) AS running FROM states")
def u3(spark, d):
    f = lambda t: (s := t.sort_values("idx"))[KEY].assign(running=s["phi"].cumsum())
    return rounded(H.per_simulation(A.states(spark, d).select(*KEY, "phi"), f, "ensemble_id string, replica int, idx int, running double"), "running")


@query("U4_every_column", f"{BASE} SELECT ensemble_id, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(phi), 6) AS phi FROM states GROUP BY 1")
def u4(spark, d):
    return A.states(spark, d).groupBy("ensemble_id").agg(*H.every_column(lambda c: r(F.avg(c)), ["a", "b", "phi"]))


BY_NAME = {"S_x": "S_x", "S_global": "S_global", "phi6": "Phi6", "elliptic": "EllipticPhi6", "s_local": "S_local", "mean_distance": "MeanSegmentDist"}


@query("U5_order_by_name", f"{ORDERS_SQL}, {S_GLOBAL_SQL} SELECT {K}, round(avg(cos(2*t)), 6) + 0.0 AS \"S_x\", round(avg(v), 6) AS \"S_global\", round(avg(phi6), 6) AS phi6, round(avg(ephi6), 6) AS elliptic, round(avg(s_local), 6) AS s_local, round(avg(mean_distance), 6) AS mean_distance FROM orders LEFT JOIN elliptic USING ({K}, pid) JOIN sg USING ({K}, pid) GROUP BY ALL")
def u5(spark, d):
    given = O.Graph(particles(spark, d), edges(spark, d), A.states(spark, d))
    rows = O.by_name(given, list(BY_NAME.values()))
    return rows.groupBy(*KEY).agg(*[r(F.avg(c)).alias(n) for n, c in BY_NAME.items()])
