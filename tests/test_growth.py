"""Work and rows that grow no faster than what is given."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.operators import graph as N
from rodfield.operators import pairs as P
from rodfield.operators import structure as S

EDGE = "ensemble_id string, replica int, idx int, i long, j long"


def test_components_shrink_by_rounds(spark, monkeypatch):
    """Long paths, rings and stars with mixed ids: right labels, and all rounds together keep a few times the rows of the graph."""
    kept = []
    cut = S.cut

    def counted(df):
        kept.append((made := cut(df)).count())
        return made

    monkeypatch.setattr(S, "cut", counted)
    random.seed(8)
    ids = random.sample(range(5000), 600)
    parts = [ids[:400], ids[400:500], ids[500:599], ids[599:]]
    edges = [*zip(parts[0], parts[0][1:]), *zip(parts[1], [*parts[1][1:], parts[1][0]]), *((parts[2][0], p) for p in parts[2][1:])]
    rows = [("e", 0, k, i, j) for k in (0, 1) for i, j in edges if k == 0 or i != ids[200]]
    vertices = spark.createDataFrame([("e", 0, k, p) for k in (0, 1) for p in ids], "ensemble_id string, replica int, idx int, pid long")
    got = {(r.idx, r.pid): r.label for r in S.components(vertices, spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {(k, p): min(part) for k in (0, 1) for part in (parts if k == 0 else [parts[0][:201], parts[0][201:], *parts[1:]]) for p in part}
    assert sum(kept) < 4 * (len(rows) + vertices.count())


def test_trial_ratios_repeat_no_bonds(spark):
    """The scan equals the order taken at each ratio by itself; ratios come out of the means of states, not of bonds."""
    random.seed(3)
    bonds = [("e", 0, k, i, random.gauss(0, 1), random.gauss(0, 1)) for k in (0, 1) for i in range(9) for _ in range(1 + i % 5)]
    b = spark.createDataFrame(bonds, "ensemble_id string, replica int, idx int, i long, dx double, dy double")
    turned = spark.createDataFrame([("e", 0, k, i, random.uniform(0, 3)) for k in (0, 1) for i in range(9)], "ensemble_id string, replica int, idx int, pid long, angle double")
    scan = S.gamma_scan(b, turned, 5)
    got = {(r.idx, r.trial): r.order for r in scan.collect()}
    rows = b.join(turned.withColumnRenamed("pid", "i"), [*KEY, "i"])
    want = {(r.idx, g): r.order for g in (1.0, 1.25, 1.5, 1.75, 2.0) for r in S.turned_order(rows, F.col("angle"), F.lit(g)).groupBy(*KEY).agg(F.avg("order").alias("order")).collect()}
    assert got == pytest.approx(want)
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")


@pytest.mark.parametrize("block", [6, 1024])
def test_widest_pairs_from_corners_alone(spark, monkeypatch, block):
    """The largest distance by brute force, also on lines, grids, circles and one place; of a cloud only few points are corners."""
    monkeypatch.setattr(P, "BLOCK", block)
    random.seed(4)
    states = [[(random.gauss(0, 3), random.gauss(0, 1)) for _ in range(70)], [(0.1 * k, 0.3 * k) for k in range(20)], [(0.1 * i, 0.1 * j) for i in range(5) for j in range(6)]]
    states += [[(math.cos(k), math.sin(k)) for k in range(25)], [(2.0, 1.0)] * 9, [(5.0, 5.0)]]
    rows = [("e", 0, k, i, x, y) for k, points in enumerate(states) for i, (x, y) in enumerate(points)]
    got = {r.idx: (r.low, r.high) for r in P.widest(spark.createDataFrame(rows, "ensemble_id string, replica int, idx int, pid long, x double, y double")).collect()}
    assert got == {k: (0.0, pytest.approx(max(math.dist(p, q) for p in points for q in points), abs=1e-15)) for k, points in enumerate(states)}
    x, y = np.random.default_rng(2).normal(0, 1, (2, 5000))
    assert len(P._outermost(x, y)) < 50


@pytest.mark.parametrize("reach", [0.5, 2.0, 30.0])
def test_close_pairs_meet_once(spark, reach):
    """Pairs by brute force, in order and with a value of their own, on both sides of zero and on cells' edges; a particle is sent to five cells, not nine."""
    random.seed(11)
    points = [(random.gauss(0, 2), random.gauss(0, 2)) for _ in range(90)] + [(2.0 * i, -2.0 * j) for i in range(-2, 3) for j in range(3)] + [(1.5, 1.5)] * 3 + [(1e12, -1e12), (1e12, -1e12)]
    ids = random.sample(range(1000), len(points))
    df = spark.createDataFrame([("e", 0, k, i, x, y, 0.1 * i) for k in (0, 1) for i, (x, y) in zip(ids, points)], "ensemble_id string, replica int, idx int, pid long, x double, y double, t double")
    found = P.close_pairs(df, reach, ("t",), {"apart": F.abs(F.col("t_i") - F.col("t_j"))})
    at, far = dict(zip(ids, points)), lambda p, q: math.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1]))
    want = {(k, i, j): far(at[i], at[j]) for k in (0, 1) for i in ids for j in ids if i < j}
    want = {key: d for key, d in want.items() if d < reach}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.idx, r.pid_i, r.pid_j): r.r for r in rows} == want
    assert all(r.apart == abs(0.1 * r.pid_i - 0.1 * r.pid_j) for r in rows)
    (line,) = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert line.count("],[") + 1 == 5


def test_close_rods_take_angles_once_a_particle(spark):
    """No cosine is taken above the join of pairs, and the distances are those by angles."""
    from rodfield.functions.columns import segment_distance, turned_distance
    from rodfield.plans import registry

    plan = registry.queries()["C16_segment_distance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "COS(" not in plan[: plan.index("Join")] and "COS(" in plan
    random.seed(7)
    rows = [[random.choice((random.uniform(-2, 2), 0.5)) for _ in range(6)] for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, t double, u double, v double, w double")
    both = df.select(segment_distance(F.lit(0.7), *"xytuvw").alias("a"), turned_distance(F.lit(0.7), "x", "y", F.cos("t"), F.sin("t"), "u", "v", F.cos("w"), F.sin("w")).alias("b")).collect()
    one, two = ({c: np.array([r[k] for r in rows]) for c, k in zip(("x", "y", "t"), at)} | {"gamma": np.full(len(rows), 1 / 0.3)} for at in ((0, 1, 2), (3, 4, 5)))
    assert [r.a for r in both] == [r.b for r in both] and [r.a for r in both] == pytest.approx(P.rods(one, two).tolist(), abs=1e-9)


def joins(df):
    return sum(line.lstrip(" :+-").startswith("Join ") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_bonds_are_made_once_for_all_orders(spark):
    """Boundary, elliptic order and triangles of a random graph by plain loops; bonds are met with particles once, and no neighbours are paired by joins."""
    random.seed(6)
    at = {i: (random.gauss(0, 2), random.gauss(0, 1), random.uniform(0, 3)) for i in range(18)}
    pairs = {(i, j) for i in range(16) for j in range(i + 1, 16) if random.random() < 0.25} | {(16, 17)}
    near = {i: {j for e in pairs for j in e if i in e and j != i} for i in at}
    particles = spark.createDataFrame([("e", 0, k, i, *p, 1.7) for k in (0, 1) for i, p in at.items()], "ensemble_id string, replica int, idx int, pid long, x double, y double, t double, gamma double")
    edges = spark.createDataFrame([("e", 0, k, i, j) for k in (0, 1) for i, j in pairs], EDGE)
    edge = {p for i, j in pairs if len(near[i] & near[j]) == 1 for p in (i, j)}
    assert edge and edge != set(at)
    found, alone, three = N.order_parameters(particles, edges), N.graph_boundary(edges), S.rod_triangles(edges)
    assert (joins(found), joins(alone), joins(three)) == (3, 1, 1)
    assert {(r.idx, r.pid) for r in alone.collect()} == {(k, p) for k in (0, 1) for p in edge}
    corners = [(r.idx, r.a, r.b, r.c) for r in three.collect()]
    want = {(k, i, j, m) for k in (0, 1) for i, j in pairs for m in near[i] & near[j] if m > j}
    assert want and len(corners) == len(want) and set(corners) == want
    rows = found.collect()
    assert len(rows) == 36
    for r in rows:
        assert r.on_boundary == (r.pid in edge) and r.z == len(near[r.pid])
        turned = [(dx * math.cos(r.DirectorAngle) + dy * math.sin(r.DirectorAngle), 1.7 * (dy * math.cos(r.DirectorAngle) - dx * math.sin(r.DirectorAngle))) for dx, dy in ((at[j][0] - r.x, at[j][1] - r.y) for j in near[r.pid])]
        mean = sum((complex(*w) / abs(complex(*w))) ** 6 for w in turned) / r.z if r.z else 0
        assert r.EllipticPhi6 == (pytest.approx(abs(mean)) if r.z else None)


def test_named_orders_deal_no_lists(spark):
    """Without C6 no lists of neighbours are held, what follows from a particle's own row joins no particles; with C6 values are the same."""
    from rodfield.operators import by_name as O

    random.seed(12)
    particles = spark.createDataFrame([("e", 0, k, i, random.gauss(0, 2), random.gauss(0, 1), random.uniform(0, 3), 1.7) for k in (0, 1) for i in range(15)], "ensemble_id string, replica int, idx int, pid long, x double, y double, t double, gamma double")
    edges = spark.createDataFrame([("e", 0, k, i, j) for k in (0, 1) for i in range(14) for j in range(i + 1, 14) if random.random() < 0.3], EDGE)
    names = ["S_x", "S_global", "Phi6", "EllipticPhi6", "S_local", "MeanSegmentDist"]
    few, more = (O.by_name(O.Graph(particles, edges, None), n) for n in (names, [*names, "C6"]))
    assert few.columns == [*particles.columns, *names[2:], *names[:2]]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and joins(few) == 5
    rows, again = ({(r.idx, r.pid): r for r in df.collect()} for df in (few, more))
    assert len(rows) == 30 and all([rows[k][n] for n in names] == [pytest.approx(v) if v is not None else None for v in (again[k][n] for n in names)] for k in rows)
    for k in (0, 1):
        t = [r.t for r in rows.values() if r.idx == k]
        c, s = (sum(f(2 * x) for x in t) / len(t) for f in (math.cos, math.sin))
        assert sum(r.S_global for r in rows.values() if r.idx == k) / len(t) == pytest.approx(math.hypot(c, s))


def test_votes_deal_lists_of_neighbours(spark):
    """Votes by plain loops over three rounds; a round joins lists by particle, not an edge in each direction."""
    random.seed(9)
    pairs = {(i, j) for i in range(12) for j in range(i + 1, 12) if random.random() < 0.3}
    near = {i: [j for e in pairs for j in e if i in e and j != i] for i in range(13)}
    now = {i: random.randrange(3) for i in near}
    labels = spark.createDataFrame([("e", 0, 0, i, v) for i, v in now.items()], "ensemble_id string, replica int, idx int, pid long, l int")
    edges = spark.createDataFrame([("e", 0, 0, i, j) for i, j in pairs], EDGE)
    got = {r.pid: r.l for r in N.vote(labels, edges, "l", 3).collect()}
    for _ in range(3):
        seen = {i: [now[j] for j in near[i]] for i in near}
        now = {i: min(set(v), key=lambda c: (-v.count(c), c)) if v else -1 for i, v in seen.items()}
    assert got == now
    plan = N.vote(labels, edges, "l")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.count("Aggregate") == 3


def test_shared_tables_leave_nothing_of_their_way(spark):
    """A triangulation's tables are gone once it is shared, as they would be many times its size; a build that fails leaves none either."""
    from pathlib import Path

    from rodfield.plans import graph_queries, lineage

    folder = Path(lineage.shared_folder(spark).removeprefix("file:"))
    kept = lambda: {p for name in ("rdd-*", "stored-*") for p in folder.rglob(name)}
    source, before = "/root/testdata/sf0.001", kept()
    lineage.forget(spark, source)
    found = graph_queries.triangles(spark, source)
    assert found.count() > 10_000 and kept() == before
    state = lambda k: spark.range(k).selectExpr("id AS pid")
    with pytest.raises(ValueError):
        lineage.shared(spark, source, "none", lambda: (lineage.stored(state(3)), int("x"))[0])
    assert kept() == before
    assert lineage.shared(spark, source, "some", lambda: lineage.stored(state(3))).count() == 3 and kept() == before


@pytest.mark.parametrize(("held", "tables"), [(1 << 18, 1), (40, 3)])
def test_events_are_solved_without_rounds_where_they_fit(spark, monkeypatch, held, tables):
    """Events by plain loops over states with a gap; a graph that fits a task takes no rounds, a larger one is contracted until it does, with the same result."""
    cuts, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: (cuts.append(1), cut(df))[1])
    monkeypatch.setattr(S, "HELD", held)
    random.seed(13)
    ids = random.sample(range(900), 60)
    graphs = {k: {tuple(sorted(random.sample(ids, 2))) for _ in range(n)} for k, n in ((0, 50), (1, 45), (2, 90), (4, 50), (5, 12))}
    graphs[2] |= {e for e in graphs[1] if random.random() < 0.7}
    bodies = {(k, p): random.random() < 0.9 for k in graphs for p in ids}
    z = {key: sum(key[1] in e for e in graphs[key[0]]) if body else 6 for key, body in bodies.items()}
    want = set()
    for k in (1, 2, 5):
        left = {p for e in graphs[k] - graphs[k - 1] for p in e}
        while left:
            part, more = set(), {min(left)}
            while more:
                part |= more
                more = {q for e in graphs[k] for p, q in (e, e[::-1]) if p in part and q in left} - part
            left -= part
            sums = [sum(max(0, sign * (z[at, p] - 6)) for p in part) for at in (k - 1, k) for sign in (-1, 1)]
            want.add((k, min(part), len(part), *sums))
    edges = spark.createDataFrame([("e", 0, k, i, j) for k, es in graphs.items() for i, j in es], EDGE)
    given = spark.createDataFrame([("e", 0, k, p, body) for (k, p), body in bodies.items()], "ensemble_id string, replica int, idx int, pid long, body boolean")
    rows = S.rearrangements(given, edges).collect()
    assert len(rows) == len(want) and {tuple(r)[2:] for r in rows} == want and max(r.size for r in rows) > 40
    assert len(cuts) == 1 if tables == 1 else len(cuts) >= tables


def test_events_are_shared(spark):
    """T4's events are found once a session; T5 reads them."""
    from rodfield.plans import lineage, registry

    found = registry.queries()["T4_rearrangements"](spark, "/root/testdata/sf0.001").collect()
    plan = registry.queries()["T5_event_sizes"](spark, "/root/testdata/sf0.001")
    assert joins(plan) == 0 and sum(r["count"] for r in plan.collect()) == len(found) > 0
    lineage.forget(spark, "/root/testdata/sf0.001")


def test_tiles_are_sent_margins_once(spark):
    """Of a dense state a tile is sent what lies in its margin, not all tiles around it, and once: bytes shuffled a point."""
    from rodfield.operators import delaunay

    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    n, before = 30_000, set(shuffled())
    points = spark.range(n, numPartitions=4).selectExpr("'e' AS ensemble_id", "0 AS replica", "0 AS idx", "id AS pid", "rand(3) AS x", "rand(4) AS y")
    found = delaunay.triangulate(points)
    assert found.selectExpr("explode(array(a, b, c)) AS p").distinct().count() == n and 2 * n - 400 < found.count() < 2 * n
    sent = sum(v for k, v in shuffled().items() if k not in before)
    assert sent / n < 300


def test_flat_circles_lie_on_the_side_of_their_apex():
    """Of points on a line by their roundings, what must be empty lies beyond the line, not on the side where others are, and has a direction."""
    from rodfield.operators import delaunay

    wide = 0
    random.seed(1)
    for _ in range(100):
        t, cx, cy = random.uniform(0, math.pi), random.uniform(-20, 20), random.uniform(-20, 20)
        line = [(cx + (j - 7) * 0.1 / 1.7 * math.cos(t), cy + (j - 7) * 0.1 / 1.7 * math.sin(t)) for j in range(9)]
        rest = [(cx + 0.3 * math.cos(t) - s * math.sin(t), cy + 0.3 * math.sin(t) + s * math.cos(t)) for s in (0.4, 0.7)]
        x, y = (np.array(v) for v in zip(*line, *rest))
        seen = ~np.eye(len(x), dtype=bool)
        f = delaunay.fans(x, y, np.tile(x, (len(x), 1)), np.tile(y, (len(x), 1)), seen, np.tile(np.arange(len(x)), (len(x), 1)))
        assert np.isfinite(f["u"]).all() and np.isfinite(f["v"]).all()
        for row, u, v, r in zip(f["row"], f["u"], f["v"], f["r"]):
            if r > 1e6:
                wide += 1
                # across the line, away from the others
                assert -u * math.sin(t) + v * math.cos(t) < 0
    assert wide > 20
