"""The graph over all states of a run, against plain loops."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from rodfield.config import KEY
from rodfield.operators import by_name, delaunay
from rodfield.operators import structure as S
from rodfield.plans import registry
from rodfield.sources.adapters import FRAMES

FEW = 40
POINT = "ensemble_id string, replica int, idx int, pid long, x double, y double"


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """One run of FEW particles whose states all differ."""
    random.seed(5)
    folder = str(tmp_path_factory.mktemp("runs"))
    rows = [(i, 0, [random.uniform(-0.2, 0.2) for _ in range(3 * FRAMES)]) for i in range(FEW)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, {i: e for i, _, e in rows}


def collected(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def triangles_of(points):
    """Delaunay triangles by the definition: circles with nothing inside."""
    out = set()
    for (i, a), (j, b), (k, c) in combinations(sorted(points.items()), 3):
        u, v, s, t = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (u * t - v * s)
        if k < 0 or abs(d) < 1e-12:
            continue
        x, y = (t * (u * u + v * v) - v * (s * s + t * t)) / d, (u * (s * s + t * t) - s * (u * u + v * v)) / d
        if all(math.dist(q, (a[0] + x, a[1] + y)) >= math.hypot(x, y) - 1e-9 for q in points.values()):
            out.add((i, j, k))
    return out


@pytest.mark.parametrize("ring", [0, 16])
def test_triangulation_brute_force(spark, ring):
    random.seed(ring)
    points = {i: (random.gauss(0, 1), random.gauss(0, 3)) for i in range(28)} | {-1 - g: (12 * math.cos(g + 0.3), 12 * math.sin(g + 0.3)) for g in range(ring)}
    rows = [("e", 0, k, p, x + 100 * k, y) for k in range(2) for p, (x, y) in points.items()]
    got = delaunay.triangulate(spark.createDataFrame(rows, POINT)).collect()
    want = triangles_of(points)
    assert len(got) == 2 * len(want) and {(r.idx, r.a, r.b, r.c) for r in got} == {(k, *t) for k in range(2) for t in want}


@pytest.mark.parametrize("nearest", [(8,), ()])
def test_fans_over_the_nearest_points_first(monkeypatch, nearest):
    import pyarrow as pa

    monkeypatch.setattr(delaunay, "NEAREST", nearest)
    random.seed(4)
    points = {i: (random.random(), random.random() ** 2) for i in range(60)}
    cell = [{"pid": i, "x": x, "y": y} for i, (x, y) in points.items()]
    kind = pa.list_(pa.struct([("pid", pa.int64()), ("x", pa.float64()), ("y", pa.float64())]))
    box = [pa.array([v]) for v in (-9.0, -9.0, 9.0, 9.0)]
    batch = pa.RecordBatch.from_arrays([pa.array(["e"]), pa.array([0]), pa.array([0]), *[pa.array([0], pa.int32())] * 3, *box, pa.array([cell], kind), pa.array([cell], kind)], [*KEY, *delaunay.OWN, "x0", "y0", "x1", "y1", "own", "near"])
    rows = [r for b in delaunay._fan_rows(iter([batch])) for r in b.to_pylist()]
    made = [tuple(r[c] for c in "abc") for r in rows if r["a"] is not None]
    assert len(made) == len(set(made)) and set(made) == triangles_of(points)
    # what is open are the two ends of each fan on the hull, and circles that leave the box
    assert all(r["r"] == 0 or r["nx"] is not None or r["x"] - r["r"] < -9 or r["x"] + r["r"] > 9 or r["y"] - r["r"] < -9 or r["y"] + r["r"] > 9 for r in rows if not r["sure"] and r["a"] is None)


@pytest.mark.parametrize("tile", [4, 256])
def test_tiled_triangulation_brute_force(spark, monkeypatch, tile):
    """Clusters, lines of points and voids between them, in many tiles."""
    monkeypatch.setattr(delaunay, "TILE", tile)
    random.seed(tile)
    points = {i: (random.gauss(0, 1e-3), random.gauss(0, 1e-3)) for i in range(12)}
    points |= {20 + i: (5 + random.gauss(0, 1), random.gauss(0, 3)) for i in range(14)}
    points |= {40 + i: (-3 + 0.06 * i * math.cos(0.7), 2 + 0.06 * i * math.sin(0.7)) for i in range(9)}
    points |= {-1 - g: (15 * math.cos(g + 0.3), 15 * math.sin(g + 0.3)) for g in range(14)}
    rows = [("e", 0, 0, p, x, y) for p, (x, y) in points.items()]
    got = [(r.a, r.b, r.c) for r in delaunay.triangulate(spark.createDataFrame(rows, POINT)).collect()]
    want = triangles_of(points)
    assert len(got) == len(set(got)) and set(got) == want


def checked_exactly(points, triangles):
    """Triangles of a state against the definition in whole numbers: circles empty inside, and as much area as the hull."""
    places = dict(zip(points, delaunay.whole_numbers(*points.values()), strict=True))
    assert len(triangles) == len(set(triangles))
    total = 0
    for t in triangles:
        o, p, q = (places[i] for i in t)
        area = delaunay.side_of(o, p, q)
        p, q = (p, q) if area > 0 else (q, p)
        assert area != 0 and all(delaunay.inside(o, p, q, s) <= 0 for s in places.values())
        total += abs(area)
    hull = []
    for sign in (1, -1):
        half = []
        for s in sorted(set(places.values()), reverse=sign < 0):
            while len(half) > 1 and delaunay.side_of(half[-2], half[-1], s) <= 0:
                half.pop()
            half.append(s)
        hull += half[:-1]
    assert total == sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, [*hull[1:], hull[0]], strict=True))


@pytest.mark.parametrize("tile", [6, 256])
def test_triangulation_of_grids_is_exact(spark, monkeypatch, tile):
    """Points of which very many lie on a line or on a circle, some only by their roundings."""
    monkeypatch.setattr(delaunay, "TILE", tile)
    random.seed(3)
    grid = {i: (float(i % 8), float(i // 8)) for i in range(64)}
    turned = {i: (i % 7 * 0.1 * math.cos(0.3) - i // 7 * 0.1 * math.sin(0.3), i % 7 * 0.1 * math.sin(0.3) + i // 7 * 0.1 * math.cos(0.3)) for i in range(49)}
    circle = {i: (100 + math.cos(i * math.pi / 12), 1e3 + math.sin(i * math.pi / 12)) for i in range(24)} | {30: (100.0, 1e3)}
    flat = {i: (i * 0.1, i * 0.3) for i in range(20)} | {40: (1.0, 1.0), 41: (0.5, 3.7)}
    states = [grid, turned, circle, flat]
    rows = [("e", 0, k, p, x, y) for k, state in enumerate(states) for p, (x, y) in state.items()]
    by = {}
    for r in delaunay.triangulate(spark.createDataFrame(rows, POINT)).collect():
        by.setdefault(r.idx, []).append((r.a, r.b, r.c))
    for k, state in enumerate(states):
        checked_exactly(state, by[k])


def test_no_point_looks_at_a_whole_state(spark, monkeypatch):
    """Of a large uneven state every try hands a tile a small part of the points."""
    shares = []
    tried = delaunay._tried

    def watched(points, active, known, reach):
        sizes = points.groupBy(*KEY, *[points[c].alias(f"t_{c}") for c in delaunay.OWN]).count()
        seen = known.join(active.select(*KEY, *delaunay.OWN).distinct(), [*KEY, *delaunay.OWN], "left_semi").join(sizes, [*KEY, "t_lv", "t_cx", "t_cy"])
        shares.append(seen.groupBy(*KEY, *delaunay.OWN).sum("count").agg({"sum(count)": "max"}).first()[0])
        return tried(points, active, known, reach)

    monkeypatch.setattr(delaunay, "_tried", watched)
    n = 30_000
    rng = np.random.default_rng(1)
    rod = rng.integers(0, 600, n)
    x, y, t = rng.normal(0, 40, 600)[rod], rng.normal(0, 10, 600)[rod], rng.uniform(0, math.pi, 600)[rod]
    along = rng.uniform(-1, 1, n)
    ring = 2000
    angle = np.arange(ring) * 2 * math.pi / ring
    xs, ys = np.concatenate([x + along * np.cos(t), 300 * np.cos(angle)]), np.concatenate([y + along * np.sin(t), 300 * np.sin(angle)])
    rows = [("e", 0, 0, i if i < n else n - 1 - i, float(xs[i]), float(ys[i])) for i in range(n + ring)]
    found = delaunay.triangulate(spark.createDataFrame(rows, POINT).repartition(8))
    # Euler: all points lie inside the ring, so each triangle but those of ring points alone is there
    assert max(shares) < 6000
    degree = found.selectExpr("explode(array(a, b, c)) AS p").where("p >= 0").distinct().count()
    assert degree == n and found.count() > 2 * n - 10


def test_triangulation_of_one_circle_and_of_one_place(spark):
    square = [("e", 0, 0, i, float(i % 2), float(i // 2)) for i in range(4)]
    line = [("e", 0, 1, i, float(i), 0.0) for i in range(4)]
    twins = [("e", 0, 2, 0, 0.0, 0.0), ("e", 0, 2, 1, 0.0, 0.0), ("e", 0, 2, 2, 1.0, 0.0), ("e", 0, 2, 3, 0.3, 1.0)]
    alone = [("e", 0, 3, 0, 0.0, 0.0)]
    by = {}
    for r in delaunay.triangulate(spark.createDataFrame(square + line + twins + alone, POINT)).collect():
        by.setdefault(r.idx, set()).add((r.a, r.b, r.c))
    assert len(by[0]) == 2 and 1 not in by and 3 not in by
    assert by[2] == {(0, 2, 3), (1, 2, 3)}


def test_bond_changes_of_every_step(spark, runs):
    folder, _ = runs
    edges = {k: set() for k in range(FRAMES)}
    for r in collected(spark, folder, "C5_T7_graph_edges"):
        edges[r.idx].add((r.i, r.j))
    assert all(edges.values())
    want = {(k, *e, 1) for k in range(1, FRAMES) for e in edges[k] - edges[k - 1]} | {(k, *e, -1) for k in range(1, FRAMES) for e in edges[k - 1] - edges[k]}
    got = [(r.idx, r.i, r.j, r.change) for r in collected(spark, folder, "T2_bond_changes")]
    assert len(got) == len(want) and set(got) == want


def test_events_take_no_charge_near_the_box(spark):
    """A state whose particles near the box are not those on the graph's boundary: charges of events follow the former."""
    # a hexagonal patch: particle 0 with six neighbours, in the second state one bond flipped
    around = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (1, 6)]
    spokes = [(0, k) for k in range(1, 7)]
    outer = [(1, 7), (2, 7), (7, 8), (2, 8), (3, 8)]
    one = spokes + around + outer
    two = [e for e in one if e != (1, 2)] + [(0, 7)]
    edges = spark.createDataFrame([("e", 0, k, i, j) for k, es in enumerate((one, two)) for i, j in es], "ensemble_id string, replica int, idx int, i long, j long")
    near = {0: {3, 8}, 1: {7}}
    bodies = spark.createDataFrame([("e", 0, k, p, p not in near[k]) for k in (0, 1) for p in range(9)], "ensemble_id string, replica int, idx int, pid long, body boolean")
    z = [{p: 6 if p in near[k] else sum(p in e for e in es) for p in range(9)} for k, es in enumerate((one, two))]
    got = S.rearrangements(bodies, edges).collect()
    part = lambda k, sign: sum(max(0, sign * (z[k][p] - 6)) for p in (0, 7))
    assert [(r.size, r.prev_neg, r.prev_pos, r.cur_neg, r.cur_pos) for r in got] == [(2, part(0, -1), part(0, 1), part(1, -1), part(1, 1))]
    # by the graph's boundary all of these but particle 0 would have none
    from rodfield.operators.graph import graph_boundary

    edge = {r.pid for r in graph_boundary(edges).where("idx = 0").collect()}
    assert 7 in edge and 7 not in near[0] and got[0].prev_neg == part(0, -1) > 0


def test_rod_distances_of_every_state(spark, runs):
    folder, given = runs
    got = {r.idx: r.mean_centre for r in collected(spark, folder, "P4_rod_pair_distance")}
    assert set(got) == set(range(FRAMES))
    for k, value in got.items():
        at = [(40 * float(e[3 * k]), 40 * float(e[3 * k + 1])) for e in given.values()]
        pairs = [math.dist(a, b) for i, a in enumerate(at) for b in at[:i]]
        assert value == pytest.approx(sum(pairs) / len(pairs), abs=1e-4)


def _run(spark):
    random.seed(2)
    rows = [("e", 0, 0, i, random.uniform(-2, 2), random.uniform(-1.5, 1.5), random.uniform(0, 3), 1.2) for i in range(7)]
    particles = spark.createDataFrame(rows, f"{POINT}, t double, gamma double")
    states = spark.createDataFrame([("e", 0, 0, 7, 2.6, 2.2, 1.2, 0.5)], "ensemble_id string, replica int, idx int, n int, a double, b double, gamma double, phi double")
    return particles, states, rows


def test_rods_from_their_disks_brute_force(spark):
    particles, states, rows = _run(spark)
    points = {r.pid: (r.x, r.y) for r in S.disk_points(particles, states, 0.5).collect()}
    assert sum(p >= 0 for p in points) == 7  # one disk a rod at this spacing
    points = {r.pid: (r.x, r.y) for r in S.disk_points(particles, states, 0.2).collect()}
    real = {(p // S.DISKS, p % S.DISKS): xy for p, xy in points.items() if p >= 0}
    assert len(real) == 7 * 3
    for _, _, _, i, x, y, t, _ in rows:
        for j in range(3):
            assert real[i, j] == pytest.approx((x + (j - 1) * 0.2 / 1.2 * math.cos(t), y + (j - 1) * 0.2 / 1.2 * math.sin(t)))
    want = {}
    edges = {e for t in triangles_of(points) for e in combinations(t, 2) if e[0] >= 0}
    for a, b in edges:
        i, j = sorted((a // S.DISKS, b // S.DISKS))
        if i != j:
            want[i, j] = want.get((i, j), 0) + 1
    got = S.rod_edges(delaunay.triangulate(S.disk_points(particles, states, 0.2)))
    assert {(r.i, r.j): r.w for r in got.collect()} == want
    kinds = {(r.i, r.j): r.type for r in S.edge_types(got, 3).collect()}
    assert kinds == {e: 0 if w < 1.5 else 1 if w < 4.5 else 2 for e, w in want.items()}


def test_ellipse_points_have_equal_arcs(spark):
    _, states, _ = _run(spark)
    for turned in (False, True):
        df = states.select(*KEY, states.b.alias("a"), states.a.alias("b"), "gamma") if turned else states
        rows = sorted(S.ellipse_points(df, 0.05).collect(), key=lambda r: r.g)
        one, two = (2.6 + 1 / 1.2, 2.2 + 1 / 1.2)[:: -1 if turned else 1]
        t = np.unwrap([math.atan2(r.y / two, r.x / one) for r in rows])
        assert all(abs((r.x / one) ** 2 + (r.y / two) ** 2 - 1) < 1e-9 for r in rows)
        fine = np.linspace(t[0], t[0] + 2 * math.pi, 400_001)
        arcs = np.concatenate([[0], np.cumsum(np.hypot(one * np.sin((fine[1:] + fine[:-1]) / 2), two * np.cos((fine[1:] + fine[:-1]) / 2)) * np.diff(fine))])
        steps = np.diff(np.interp(t, fine, arcs))
        assert len(rows) == round(arcs[-1] / 0.05) and np.allclose(steps, arcs[-1] / len(rows), atol=1e-7)


def test_fitted_ellipses_by_least_squares(spark):
    particles, states, _ = _run(spark)
    edges = S.rod_edges(delaunay.triangulate(S.disk_points(particles, states, 0.2)))
    from rodfield.operators.graph import directed_bonds

    bonds = directed_bonds(particles, edges)
    near = {}
    for r in bonds.collect():
        near.setdefault(r.i, []).append((r.dx, r.dy))
    for r in S.fitted_ellipses(bonds).collect():
        d = np.array(near[r.pid])
        if len(d) < 3:
            assert r.fitted_gamma == -1
            continue
        p, q, s = np.linalg.lstsq(np.stack([d[:, 0] ** 2, d[:, 0] * d[:, 1], d[:, 1] ** 2], 1), np.ones(len(d)), rcond=None)[0]
        low, high = np.linalg.eigvalsh([[p, q / 2], [q / 2, s]])
        assert r.fitted_gamma == (pytest.approx(math.sqrt(high / low), rel=1e-4) if low > 0 else -1)


def test_orders_by_name(spark):
    particles, states, _ = _run(spark)
    edges = S.rod_edges(delaunay.triangulate(S.disk_points(particles, states, 0.2))).persist()
    graph = by_name.Graph(particles, edges, states)
    names = [*by_name.names(), "Phi8Complex", "director-1"]
    rows = by_name.by_name(graph, names)
    assert set(names) <= set(rows.columns)
    got = by_name.by_name(graph, ["Phi6", "Phi6Complex", "isolatedDefect", "dense_1", "Phi_S_mask"]).collect()
    assert len(got) == 7 and all(r.Phi6 is None or r.Phi6 == pytest.approx(math.hypot(r.Phi6Complex.re, r.Phi6Complex.im)) for r in got)
    with pytest.raises(ValueError):
        by_name.by_name(graph, ["none"])
    assert KEY == ["ensemble_id", "replica", "idx"]
