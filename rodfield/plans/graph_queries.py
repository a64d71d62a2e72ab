"""Queries on pairs, the triangulation, the neighbour graph and correlations, each with equivalent SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.functions import columns as C
from rodfield.operators import aggregate as G
from rodfield.operators import delaunay as T
from rodfield.operators import graph as N
from rodfield.operators import pairs as P
from rodfield.operators import structure as S
from rodfield.operators import order as D
from rodfield.plans.base_queries import BASE, S_GLOBAL_SQL, T_SQL, K, r, rounded
from rodfield.plans.lineage import shared
from rodfield.sources import adapters as A
from rodfield.sources import store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def segdist_sql(rr: str, a: str, b: str) -> str:
    """Distance of the segments of rows a and b."""
    def end(e: str, q: str, s: str) -> str:
        ex, ey = f"({e}.x + ({s})*{rr}*cos({e}.t))", f"({e}.y + ({s})*{rr}*sin({e}.t))"
        al = f"(({ex}-{q}.x)*cos({q}.t) + ({ey}-{q}.y)*sin({q}.t))"
        ac = f"(-({ex}-{q}.x)*sin({q}.t) + ({ey}-{q}.y)*cos({q}.t))"
        return f"sqrt(greatest(abs({al}) - {rr}, 0)*greatest(abs({al}) - {rr}, 0) + {ac}*{ac})"

    reach = f"abs({rr}*sin({a}.t - {b}.t))"
    cross = f"abs({b}.x-{a}.x) <= {rr}*(abs(cos({a}.t))+abs(cos({b}.t))) AND abs({b}.y-{a}.y) <= {rr}*(abs(sin({a}.t))+abs(sin({b}.t))) AND abs(({b}.x-{a}.x)*sin({a}.t) - ({b}.y-{a}.y)*cos({a}.t)) <= {reach} AND abs(({b}.x-{a}.x)*sin({b}.t) - ({b}.y-{a}.y)*cos({b}.t)) <= {reach} AND {reach} > 0"
    ends = ", ".join([end(a, b, "-1"), end(a, b, "1"), end(b, a, "-1"), end(b, a, "1")])
    return f"CASE WHEN {cross} THEN 0 ELSE least({ends}) END"


PAIRS = "FROM particles p JOIN particles q ON p.ensemble_id = q.ensemble_id AND p.replica = q.replica AND p.idx = q.idx"
PK = "p.ensemble_id, p.replica, p.idx"
RPQ = "sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y))"


@query("C13_close_pairs", f"{BASE} SELECT {PK}, p.pid AS pid_i, q.pid AS pid_j, round({RPQ}, 6) AS r {PAIRS} AND p.pid < q.pid WHERE {RPQ} < 2")
def c13(spark, d):
    return P.close_pairs(A.particles(spark, d), 2.0).select(*KEY, "pid_i", "pid_j", r("r").alias("r"))


@query("C14_pair_distances", f"{BASE} SELECT {PK}, round(min({RPQ}), 6) AS min_r, round(avg({RPQ}), 6) AS mean_r, round(min({RPQ})/avg({RPQ}), 6) AS ratio {PAIRS} AND p.pid < q.pid WHERE {RPQ} < 2 GROUP BY {PK}")
def c14(spark, d):
    return rounded(P.pair_distances(A.particles(spark, d)), "min_r", "mean_r", "ratio")


LEGAL_SQL = f"""{BASE}, c AS (SELECT {PK}, min({RPQ})/avg({RPQ}) < 0.05 AS too_close {PAIRS} AND p.pid < q.pid WHERE {RPQ} < 2 GROUP BY {PK}),
o AS (SELECT {K}, max(x*x/(a*a) + y*y/(b*b)) >= 1 AS outside FROM particles JOIN states USING ({K}) GROUP BY ALL),
l AS (SELECT {K}, outside, coalesce(too_close, false) AS too_close, outside OR coalesce(too_close, false) AS illegal FROM o LEFT JOIN c USING ({K}))"""


@query("C15_legality", f"{LEGAL_SQL} SELECT * FROM l")
def c15(spark, d):
    return P.legality(A.particles(spark, d), A.states(spark, d), 0.05)


@query("G15_legality_map", f"{LEGAL_SQL} SELECT ensemble_id, replica, " + ", ".join(f'max(CASE WHEN idx = {i} THEN CAST(illegal AS INTEGER) END) AS "{i}"' for i in range(22)) + " FROM l GROUP BY 1, 2")
def g15(spark, d):
    from rodfield.operators.aggregate import legality_map

    return legality_map(P.legality(A.particles(spark, d), A.states(spark, d), 0.05), "illegal", 22)


def _newton_sql() -> str:
    steps = ["n0 AS (SELECT *, abs(x) AS px, abs(y) AS py, CASE WHEN a < b THEN -a*a + a*abs(x) ELSE -b*b + b*abs(y) END AS s FROM particles JOIN states USING (ensemble_id, replica, idx))"]
    for i in range(16):
        g = "(a*px/(a*a+s))*(a*px/(a*a+s)) + (b*py/(b*b+s))*(b*py/(b*b+s)) - 1"
        slope = "(-2*(a*px*a*px/((a*a+s)*(a*a+s)*(a*a+s)) + b*py*b*py/((b*b+s)*(b*b+s)*(b*b+s))))"
        steps.append(f"n{i + 1} AS (SELECT * REPLACE (CASE WHEN {g} < 1e-3 THEN s ELSE s - ({g})/{slope} END AS s) FROM n{i})")
    return ", ".join(steps)


ELLIPSE = "sqrt((px - a*a*px/(a*a+s))*(px - a*a*px/(a*a+s)) + (py - b*b*py/(b*b+s))*(py - b*b*py/(b*b+s)))"


@query("C11_C12_ellipse_distance", f"{BASE}, {_newton_sql()} SELECT {K}, pid, round({ELLIPSE}, 5) AS distance, round({ELLIPSE}, 5) >= 2 AS body FROM n16")
def c11(spark, d):
    p = A.particles(spark, d).join(A.states(spark, d), KEY).withColumn("distance", r(C.ellipse_distance("x", "y", "a", "b"), 5))
    return p.select(*KEY, "pid", "distance", (F.col("distance") >= 2).alias("body"))


@query("C16_segment_distance", f"{BASE} SELECT {PK}, p.pid AS pid_i, q.pid AS pid_j, round({segdist_sql('(1 - 1/1.7)', 'p', 'q')}, 6) AS d {PAIRS} AND p.pid < q.pid WHERE {RPQ} < 4")
def c16(spark, d):
    far = C.turned_distance(F.lit(1 - 1 / 1.7), *[f"{n}_{side}" for side in "ij" for n in ("x", "y", "cos", "sin")])
    rows = P.close_pairs(A.particles(spark, d).withColumns({"cos": F.cos("t"), "sin": F.sin("t")}), 4.0, ("cos", "sin"), {"d": r(far)})
    return rows.select(*KEY, "pid_i", "pid_j", "d")


@query("C1_disks", f"{BASE} SELECT {K}, pid, CAST(j AS INTEGER) AS j, round(x + (-(m-1)/2.0 + j)*0.1/gamma*cos(t), 6) AS dx, round(y + (-(m-1)/2.0 + j)*0.1/gamma*sin(t), 6) AS dy FROM (SELECT p.*, gamma, CAST(floor(1 + 2*(gamma-1)/0.1 + 1e-9) AS INTEGER) AS m FROM particles p JOIN states USING ({K})), range(40) g(j) WHERE j < m")
def c1(spark, d):
    rows = S.disks(A.particles(spark, d).join(A.states(spark, d), KEY))
    return rounded(rows, "dx", "dy")


@query("C2_ring", f"{BASE} SELECT {K}, -1 - g AS pid, round(ring_r*cos(2*pi()*g/24 + 0.01), 6) AS x, round(ring_r*sin(2*pi()*g/24 + 0.01), 6) AS y FROM states, range(24) t(g)")
def c2(spark, d):
    return rounded(A.ring(A.states(spark, d)), "x", "y")


@query("C2_circle_points", f"{BASE}, c AS (SELECT *, greatest(a, b) + 1/gamma AS rad, CAST(round_even(2*pi()*(greatest(a, b) + 1/gamma)/0.1, 0) AS INTEGER) AS m FROM states), p AS (SELECT *, CAST(unnest(range(m)) AS INTEGER) AS g FROM c) SELECT {K}, g, round(rad*cos(2*pi()*g/m), 6) + 0.0 AS x, round(rad*sin(2*pi()*g/m), 6) + 0.0 AS y FROM p")
def c2_circle(spark, d):
    """Points by the circumference, a rod's half length beyond the longer axis."""
    return rounded(S.circle_points(A.states(spark, d), F.greatest("a", "b") + 1 / F.col("gamma")), "x", "y")


#: Triangles from the definition of a joined pair: the largest angles over it on both sides sum to pi at most. The apexes of those angles are
#: the third corners. Ring points: 24 on a circle.
POINTS_SQL = f"""pts AS MATERIALIZED (SELECT {K}, pid, x, y FROM particles UNION ALL SELECT {K}, -1 - g, ring_r*cos(2*pi()*g/24 + 0.01), ring_r*sin(2*pi()*g/24 + 0.01) FROM states, range(24) t(g)),
sees AS MATERIALIZED (SELECT p.ensemble_id, p.replica, p.idx, p.pid AS i, q.pid AS j, s.pid AS k, (q.x - p.x)*(s.y - p.y) - (q.y - p.y)*(s.x - p.x) AS turn, (p.x - s.x)*(q.x - s.x) + (p.y - s.y)*(q.y - s.y) AS dots
  FROM pts p JOIN pts q ON p.ensemble_id = q.ensemble_id AND p.replica = q.replica AND p.idx = q.idx AND p.pid < q.pid AND q.pid >= 0 JOIN pts s ON p.ensemble_id = s.ensemble_id AND p.replica = s.replica AND p.idx = s.idx AND s.pid != p.pid AND s.pid != q.pid),
apex AS MATERIALIZED (SELECT {K}, i, j, min(dots/turn) FILTER (turn > 0) AS least, min(-dots/turn) FILTER (turn < 0) AS other, arg_min(k, dots/turn) FILTER (turn > 0) AS kl, arg_min(k, -dots/turn) FILTER (turn < 0) AS kr FROM sees GROUP BY ALL HAVING coalesce(least + other, 0) >= 0),
tri AS MATERIALIZED (SELECT DISTINCT {K}, least(i, k) AS a, CASE WHEN k < i THEN i WHEN k < j THEN k ELSE j END AS b, greatest(j, k) AS c FROM (SELECT {K}, i, j, unnest([kl, kr]) AS k FROM apex) WHERE k IS NOT NULL),
e0 AS (SELECT {K}, a AS i, b AS j FROM tri UNION ALL SELECT {K}, a, c FROM tri UNION ALL SELECT {K}, b, c FROM tri),
edges AS MATERIALIZED (SELECT {K}, i, j, count(*) AS triangles FROM e0 WHERE i >= 0 GROUP BY ALL),
e2 AS MATERIALIZED (SELECT {K}, i, j FROM edges UNION ALL SELECT {K}, j, i FROM edges)"""
GRAPH = f"{BASE}, {POINTS_SQL}"
BODY_SQL = f"{_newton_sql()}, bod AS MATERIALIZED (SELECT {K}, pid, round({ELLIPSE}, 5) >= 2 AS body FROM n16)"


def particles(spark, d):
    """Particles with the ratio and number of their state."""
    return A.particles(spark, d).join(A.states(spark, d).select(*KEY, "gamma", "n"), KEY)


def triangles(spark, d):
    """Triangles of the particles' centres and the ring, of all states; built once a session."""
    def build():
        return T.triangulate(A.particles(spark, d).select(*KEY, "pid", "x", "y").unionByName(A.ring(A.states(spark, d))))

    return shared(spark, d, "triangles", build)


def edges(spark, d):
    return shared(spark, d, "edges", lambda: T.edges_of(triangles(spark, d)))


def bonds(spark, d):
    return N.directed_bonds(particles(spark, d), edges(spark, d))


def body(spark, d):
    """Particles and whether they are two units or more from the box."""
    rows = A.particles(spark, d).join(A.states(spark, d).select(*KEY, "a", "b"), KEY)
    return rows.select(*KEY, "pid", (F.round(C.ellipse_distance("x", "y", "a", "b"), 5) >= 2).alias("body"))


@query("C4_triangulation", f"{GRAPH} SELECT {K}, a, b, c FROM tri")
def c4(spark, d):
    return triangles(spark, d)


@query("C5_T7_graph_edges", f"{GRAPH} SELECT {K}, i, j, triangles FROM edges")
def c5(spark, d):
    return edges(spark, d)


@query("C7_hull_points", f"{GRAPH} SELECT DISTINCT {K}, unnest([i, j]) AS pid FROM edges WHERE triangles = 1")
def c7(spark, d):
    return T.hull_points(triangles(spark, d))


BOUNDARY_SQL = f"""sh AS (SELECT e.ensemble_id, e.replica, e.idx, e.i, e.j FROM edges e JOIN e2 f ON e.ensemble_id = f.ensemble_id AND e.replica = f.replica AND e.idx = f.idx AND e.i = f.i JOIN e2 g ON e.ensemble_id = g.ensemble_id AND e.replica = g.replica AND e.idx = g.idx AND e.j = g.i AND f.j = g.j GROUP BY ALL HAVING count(*) = 1),
bd AS (SELECT DISTINCT {K}, unnest([i, j]) AS pid FROM sh)"""


@query("C10_graph_boundary", f"{GRAPH}, {BOUNDARY_SQL} SELECT * FROM bd")
def c10(spark, d):
    return N.graph_boundary(edges(spark, d))


@query("C19_rod_triangles", f"{GRAPH} SELECT x.ensemble_id, x.replica, x.idx, x.i AS a, x.j AS b, y.j AS c FROM edges x JOIN edges y ON x.ensemble_id = y.ensemble_id AND x.replica = y.replica AND x.idx = y.idx AND x.j = y.i JOIN edges z ON x.ensemble_id = z.ensemble_id AND x.replica = z.replica AND x.idx = z.idx AND x.i = z.i AND y.j = z.j")
def c19(spark, d):
    return S.rod_triangles(edges(spark, d))


BONDS_SQL = f"""pg AS (SELECT p.*, gamma, 1 - 1/gamma AS rr FROM particles p JOIN states USING ({K})),
bonds AS MATERIALIZED (SELECT e.ensemble_id, e.replica, e.idx, e.i, e.j, q.x - p.x AS dx, q.y - p.y AS dy, atan2(q.y - p.y, q.x - p.x) AS bond, p.t AS ti, q.t AS tj, p.gamma, {segdist_sql('p.rr', 'p', 'q')} AS far
  FROM e2 e JOIN pg p ON e.ensemble_id = p.ensemble_id AND e.replica = p.replica AND e.idx = p.idx AND e.i = p.pid JOIN pg q ON e.ensemble_id = q.ensemble_id AND e.replica = q.replica AND e.idx = q.idx AND e.j = q.pid)"""
ORDERS_SQL = f"""{GRAPH}, {BOUNDARY_SQL}, {BONDS_SQL}, sums AS (SELECT {K}, i AS pid, count(*) AS z, sum(cos(4*bond)) AS c4, sum(sin(4*bond)) AS s4, sum(cos(6*bond)) AS c6, sum(sin(6*bond)) AS s6, sum(cos(2*(tj-ti))) AS cc,
  sum(cos(2*tj)) AS c2, sum(sin(2*tj)) AS s2, sum(dx*dy) AS xy, sum(dx*dx - dy*dy) AS xxyy, max(far) AS mx, avg(far) AS mean_far FROM bonds GROUP BY ALL),
o1 AS (SELECT p.*, coalesce(z, 0) AS z, coalesce(c2, 0) + cos(2*t) AS cs, coalesce(s2, 0) + sin(2*t) AS ss, bd.pid IS NOT NULL AS on_boundary, s.* EXCLUDE (ensemble_id, replica, idx, pid, z) FROM pg p LEFT JOIN sums s USING ({K}, pid) LEFT JOIN bd USING ({K}, pid)),
o2 AS (SELECT *, atan2(ss, cs + sqrt(cs*cs + ss*ss)) AS dir0, 0.5*atan2(2*xy, xxyy) AS rot0 FROM o1),
orders AS MATERIALIZED (SELECT *, sqrt(c4*c4 + s4*s4)/nullif(z, 0) AS phi4, sqrt(c6*c6 + s6*s6)/nullif(z, 0) AS phi6, cc/nullif(z, 0) AS s_center, sqrt(cs*cs + ss*ss)/(z + 1) AS s_local, dir0 - pi()*floor(dir0/pi()) AS director, rot0 - pi()*floor(rot0/pi()) AS rotation,
  coalesce(mx, 0)*gamma AS farthest, mean_far*gamma AS mean_distance FROM o2),
el AS (SELECT b.ensemble_id, b.replica, b.idx, b.i AS pid, atan2(b.gamma*(-dx*sin(director) + dy*cos(director)), dx*cos(director) + dy*sin(director)) AS w FROM bonds b JOIN orders o ON b.ensemble_id = o.ensemble_id AND b.replica = o.replica AND b.idx = o.idx AND b.i = o.pid),
elliptic AS (SELECT {K}, pid, sqrt(avg(cos(6*w))*avg(cos(6*w)) + avg(sin(6*w))*avg(sin(6*w))) AS ephi6 FROM el GROUP BY ALL)"""


def orders(spark, d):
    """All order parameters of all particles; built once a session."""
    return shared(spark, d, "orders", lambda: N.order_parameters(particles(spark, d), edges(spark, d)))


def particle_query(name: str, spark_columns: dict[str, str], sql: str, digits: int = 6, source: str = "orders"):
    """A query that shows some order parameters of each particle."""
    def run(spark, d):
        rows = orders(spark, d)
        kinds = dict(rows.dtypes)
        return rows.select(*KEY, "pid", *[(r(c, digits) if kinds.get(c, "double") == "double" else F.col(c)).alias(n) for n, c in spark_columns.items()])

    QUERIES[name], ORACLES[name] = run, f"{ORDERS_SQL} SELECT {K}, pid, {sql} FROM {source}"


particle_query("C9_coordination", {"z": "z"}, "z")
particle_query("D6_c6", {"c6_raw": "C6_raw", "c6": "C6"}, "CAST(z = 6 AS DOUBLE) AS c6_raw, CASE WHEN NOT on_boundary THEN CAST(z = 6 AS DOUBLE) END AS c6")
particle_query("D8_bond_order", {"phi4": "Phi4", "phi6": "Phi6", "phi4_re": "Phi4Complex.re", "phi4_im": "Phi4Complex.im", "phi6_re": "Phi6Complex.re", "phi6_im": "Phi6Complex.im"}, "round(phi4, 6) AS phi4, round(phi6, 6) AS phi6, round(c4/nullif(z, 0), 6) + 0.0 AS phi4_re, round(s4/nullif(z, 0), 6) + 0.0 AS phi4_im, round(c6/nullif(z, 0), 6) + 0.0 AS phi6_re, round(s6/nullif(z, 0), 6) + 0.0 AS phi6_im")
particle_query("D9_elliptic_phi6", {"elliptic": "EllipticPhi6"}, "round(ephi6, 6) AS elliptic", source=f"orders LEFT JOIN elliptic USING ({K}, pid)")
particle_query("D11_pure_rotation", {"rotation": "PureRotationAngle"}, "round(rotation, 6) AS rotation")
particle_query("D12_s_center", {"s_center": "S_center"}, "round(s_center, 6) + 0.0 AS s_center")
particle_query("D13_s_local", {"s_local": "S_local"}, "round(s_local, 6) AS s_local")
particle_query("D14_director", {"director": "DirectorAngle"}, "round(director, 6) AS director")
particle_query("D16_crystal_nematic", {"value": "CrystalNematicAngle"}, "round(cos(2*(director - rotation)), 6) + 0.0 AS value")
particle_query("D18_segment_distances", {"farthest": "FarthestSegmentDist", "mean": "MeanSegmentDist"}, "round(farthest, 6) AS farthest, round(mean_distance, 6) AS mean")
particle_query("D22_raw_dense", {"raw_dense": "raw_dense"}, "CASE WHEN farthest < 2.05 THEN 2 WHEN farthest <= 3.4 THEN 1 ELSE 0 END AS raw_dense")


@query("D8_any_fold", f"{GRAPH}, {BONDS_SQL} SELECT {K}, i AS pid, round(avg(cos(8*bond)), 6) + 0.0 AS re, round(avg(sin(8*bond)), 6) + 0.0 AS im FROM bonds GROUP BY {K}, i")
def d8(spark, d):
    return N.bond_order(bonds(spark, d), 8).select(*KEY, "pid", r("phi.re").alias("re"), r("phi.im").alias("im"))


@query("D7_D26_defects_charge", f"{ORDERS_SQL}, {BODY_SQL} SELECT {K}, count(*) FILTER (WHERE body AND z != 6) AS defects, CAST(coalesce(sum(z) FILTER (WHERE body), 0) - 6*count(*) FILTER (WHERE body) AS BIGINT) AS charge, CAST(sum(z) - 6*count(*) AS BIGINT) AS raw_charge FROM orders JOIN bod USING ({K}, pid) GROUP BY ALL")
def d26(spark, d):
    rows = orders(spark, d).join(body(spark, d), [*KEY, "pid"])
    return rows.groupBy(*KEY).agg(
        F.count_if(F.col("body") & (F.col("z") != 6)).alias("defects"), (F.coalesce(F.sum(F.when(F.col("body"), F.col("z"))), F.lit(0)) - 6 * F.count_if("body")).alias("charge"), (F.sum("z") - 6 * F.count("*")).alias("raw_charge")
    )


@query("C17_C18_bonds", f"{GRAPH}, {BONDS_SQL} SELECT {K}, i, j, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(bond, 6) + 0.0 AS angle, round(far, 6) AS distance FROM bonds WHERE i < j")
def c17(spark, d):
    return bonds(spark, d).where("i < j").select(*KEY, "i", "j", r("dx").alias("dx"), r("dy").alias("dy"), r("bond").alias("angle"), r("far").alias("distance"))


@query("D17_D25_bond_statistics", f"{GRAPH}, {BONDS_SQL} SELECT {K}, round(avg(gamma*far), 6) AS mean_distance, round(sqrt(greatest(avg(gamma*far*gamma*far) - avg(gamma*far)*avg(gamma*far), 0)), 6) AS std_distance, round(avg(CASE WHEN dx*dx + dy*dy <= 4 THEN sqrt(dx*dx + dy*dy) END), 6) AS mean_bond FROM bonds GROUP BY ALL")
def d17(spark, d):
    b = bonds(spark, d).withColumn("v", F.col("gamma") * F.col("far")).withColumn("l", F.hypot("dx", "dy"))
    rows = b.groupBy(*KEY).agg(F.avg("v").alias("mean_distance"), F.sqrt(F.greatest(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v"), F.lit(0.0))).alias("std_distance"), F.avg(F.when(F.col("l") <= 2, F.col("l"))).alias("mean_bond"))
    return rounded(rows, "mean_distance", "std_distance", "mean_bond")


@query("D19_isolated_defects", f"""{ORDERS_SQL}, {BODY_SQL}, ob AS (SELECT o.*, body FROM orders o JOIN bod USING ({K}, pid)),
iso AS (SELECT o.*, body AND z != 6 AND NOT EXISTS (SELECT 1 FROM e2 e JOIN orders q ON e.ensemble_id = q.ensemble_id AND e.replica = q.replica AND e.idx = q.idx AND e.j = q.pid WHERE e.ensemble_id = o.ensemble_id AND e.replica = o.replica AND e.idx = o.idx AND e.i = o.pid AND q.z != 6 AND q.z != o.z) AS isolated FROM ob o)
SELECT {K}, pid, z, round(CAST(isolated AS INTEGER)*count(*) OVER w/CAST(nullif(count(*) FILTER (body) OVER w, 0) AS DOUBLE), 6) AS of_body, round(CAST(isolated AS INTEGER)*count(*) OVER w/CAST(nullif(count(*) FILTER (body AND z != 6) OVER w, 0) AS DOUBLE), 6) AS of_defects FROM iso WINDOW w AS (PARTITION BY {K})""")
def d19(spark, d):
    rows = N.isolated_defects(orders(spark, d).select(*KEY, "pid", "z").join(body(spark, d), [*KEY, "pid"]), edges(spark, d))
    return rows.select(*KEY, "pid", "z", r("isolatedDefect").alias("of_body"), r("isolatedDefectRatio").alias("of_defects"))


@query("D20_windings", f"""{GRAPH}, {BONDS_SQL}, rg AS (SELECT *, (tj - pi()*floor(tj/pi()))/pi() AS u FROM bonds), nx AS (SELECT *, coalesce(lead(u) OVER w, first_value(u) OVER (PARTITION BY {K}, i ORDER BY bond ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM rg WINDOW w AS (PARTITION BY {K}, i ORDER BY bond)),
st AS (SELECT *, CASE WHEN v - u > 0.5 THEN v - u - 1 WHEN v - u < -0.5 THEN v - u + 1 ELSE v - u END AS s FROM nx) SELECT {K}, i AS pid, CASE WHEN max(CASE WHEN abs(abs(s) - 0.5) <= 1e-4 THEN 1 ELSE 0 END) = 0 THEN CAST(round(sum(s)) AS INTEGER) END AS winding FROM st GROUP BY {K}, i""")
def d20(spark, d):
    return N.windings(bonds(spark, d))


@query("D24_joint_masks", f"{ORDERS_SQL} SELECT {K}, pid, coalesce(ephi6 > 0.9 AND s_local > 0.9, false) AS phi_s, z = 6 AND s_local > 0.9 AS c6_s FROM orders LEFT JOIN elliptic USING ({K}, pid)")
def d24(spark, d):
    rows = orders(spark, d)
    return rows.select(*KEY, "pid", F.coalesce((F.col("EllipticPhi6") > 0.9) & (F.col("S_local") > 0.9), F.lit(False)).alias("phi_s"), ((F.col("z") == 6) & (F.col("S_local") > 0.9)).alias("c6_s"))


SEVEN = {"phi4": "Phi4", "phi6": "Phi6", "s_local": "S_local", "s_global": "S_global", "elliptic": "EllipticPhi6", "mean_distance": "MeanSegmentDist", "defect": "defect"}


def state_means(orders_, particles_):
    """Means of the seven order parameters by ensemble, replica and state."""
    rows = orders_.join(D.s_global(particles_).select(*KEY, "pid", "S_global"), [*KEY, "pid"]).withColumn("defect", 1 - F.col("C6"))
    return rows.groupBy(*KEY).agg(*[F.avg(c).alias(n) for n, c in SEVEN.items()])


def report(orders_, particles_):
    return rounded(state_means(orders_, particles_), *SEVEN)


@query("G6_D28_report", f"{ORDERS_SQL}, {S_GLOBAL_SQL} SELECT {K}, round(avg(phi4), 6) AS phi4, round(avg(phi6), 6) AS phi6, round(avg(s_local), 6) AS s_local, round(avg(v), 6) AS s_global, round(avg(ephi6), 6) AS elliptic, round(avg(mean_distance), 6) AS mean_distance, round(avg(1 - CASE WHEN NOT on_boundary THEN CAST(z = 6 AS DOUBLE) END), 6) AS defect FROM orders LEFT JOIN elliptic USING ({K}, pid) JOIN sg USING ({K}, pid) GROUP BY ALL")
def g6(spark, d):
    return report(orders(spark, d), A.particles(spark, d))


MEANS_SQL = f"""means AS (SELECT {K}, avg(phi4) AS phi4, avg(phi6) AS phi6, avg(s_local) AS s_local, avg(v) AS s_global, avg(ephi6) AS elliptic, avg(mean_distance) AS mean_distance,
  avg(1 - CASE WHEN NOT on_boundary THEN CAST(z = 6 AS DOUBLE) END) AS defect FROM orders LEFT JOIN elliptic USING ({K}, pid) JOIN sg USING ({K}, pid) GROUP BY ALL),
long AS (SELECT * FROM means UNPIVOT INCLUDE NULLS (v FOR op IN (phi4, phi6, s_local, s_global, elliptic, mean_distance, defect)))"""


@query("G6_averaged_report", f"{ORDERS_SQL}, {S_GLOBAL_SQL}, {MEANS_SQL}, {T_SQL}, zs AS (SELECT ensemble_id, idx, op, min_by(phi, replica) AS x, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS c FROM long JOIN states USING ({K}) GROUP BY 1, 2, 3) SELECT ensemble_id, idx, op, round(x, 6) AS x, round(mean, 6) AS mean, round(q*sd/sqrt(c), 6) AS ci, 'phi' AS x_name FROM zs LEFT JOIN tq ON dof = c - 1")
def g6_averaged(spark, d):
    """The report over all ensembles, averaged over replicas, saved by order parameter and read back."""
    return saved_report(spark, state_means(orders(spark, d), A.particles(spark, d)), A.states(spark, d))


def saved_report(spark, means, states):
    target = store.scratch(spark, "report")
    store.save_results(G.report_curves(means, states, list(SEVEN), "phi", averaged=True), target, "phi")
    return rounded(store.open_results(spark, target), "x", "mean", "ci").select("ensemble_id", "idx", "op", "x", "mean", "ci", "x_name")


@query("G12_paired_samples", f"{ORDERS_SQL} SELECT {K}, pid, round(farthest, 6) AS farthest, round(s_local, 6) AS s_local FROM orders JOIN states USING ({K}) WHERE phi < 0.24")
def g12(spark, d):
    low = A.states(spark, d).where("phi < 0.24").select(*KEY)
    return orders(spark, d).join(low, KEY).select(*KEY, "pid", r("FarthestSegmentDist").alias("farthest"), r("S_local").alias("s_local"))


@query("N1_N3_neighbour_sums", f"{GRAPH}, {BONDS_SQL} SELECT {K}, i AS pid, round(sum(tj), 6) AS sum_values, round(sum(far), 6) AS sum_weights, round(sum(cos(bond)), 6) + 0.0 AS re, round(sum(sin(bond)), 6) + 0.0 AS im, round(max(far), 6) AS max_weight FROM bonds GROUP BY {K}, i")
def n1(spark, d):
    b = bonds(spark, d).groupBy(*KEY, F.col("i").alias("pid"))
    return rounded(b.agg(F.sum("tj").alias("sum_values"), F.sum("far").alias("sum_weights"), F.sum(F.cos("bond")).alias("re"), F.sum(F.sin("bond")).alias("im"), F.max("far").alias("max_weight")), "sum_values", "sum_weights", "re", "im", "max_weight")


def _vote_sql(source: str, name: str) -> str:
    return f"""{name}v AS (SELECT e.ensemble_id, e.replica, e.idx, e.i AS pid, l, count(*) AS n FROM e2 e JOIN {source} s ON e.ensemble_id = s.ensemble_id AND e.replica = s.replica AND e.idx = s.idx AND e.j = s.pid GROUP BY ALL),
{name}w AS (SELECT *, row_number() OVER (PARTITION BY {K}, pid ORDER BY n DESC, l) AS k FROM {name}v), {name} AS MATERIALIZED (SELECT p.ensemble_id, p.replica, p.idx, p.pid, coalesce(w.l, -1) AS l FROM particles p LEFT JOIN {name}w w ON p.ensemble_id = w.ensemble_id AND p.replica = w.replica AND p.idx = w.idx AND p.pid = w.pid AND k = 1)"""


@query("N5_N6_vote", f"{GRAPH}, l0 AS (SELECT {K}, pid, CAST(floor((t - pi()*floor(t/pi()))/pi()*3) AS INTEGER) AS l FROM particles), {_vote_sql('l0', 'l1')}, {_vote_sql('l1', 'l2')} SELECT {K}, pid, l1.l AS once, l2.l AS twice FROM l1 JOIN l2 USING ({K}, pid)")
def n5(spark, d):
    import math

    e = edges(spark, d)
    labels = A.particles(spark, d).select(*KEY, "pid", F.floor(C.axis_angle("t") / math.pi * 3).cast("int").alias("l"))
    once = N.vote(labels, e, "l").withColumnRenamed("l", "once")
    return once.join(N.vote(labels, e, "l", 2).withColumnRenamed("l", "twice"), [*KEY, "pid"]).select(*KEY, "pid", "once", "twice")


@query("D22_dense", f"""{ORDERS_SQL}, d0 AS (SELECT {K}, pid, CASE WHEN farthest < 2.05 THEN 2 WHEN farthest <= 3.4 THEN 1 ELSE 0 END AS l FROM orders), r0 AS (SELECT {K}, pid, CAST(farthest <= 3.4 AS INTEGER) AS l FROM orders),
{_vote_sql('d0', 'd1')}, {_vote_sql('r0', 'r1')}, {_vote_sql('r1', 'r2')}, {_vote_sql('r2', 'r3')} SELECT {K}, pid, r0.l AS raw_dense_1, d1.l AS dense, r3.l AS dense_1 FROM r0 JOIN d1 USING ({K}, pid) JOIN r3 USING ({K}, pid)""")
def d22(spark, d):
    return N.dense_variants(orders(spark, d), edges(spark, d)).select(*KEY, "pid", "raw_dense_1", "dense", "dense_1")


BEFORE = "y.ensemble_id = x.ensemble_id AND y.replica = x.replica AND y.idx = x.idx - 1 AND y.i = x.i AND y.j = x.j"
AFTER = BEFORE.replace("x.idx - 1", "x.idx + 1")


@query("T2_bond_changes", f"{GRAPH}, last AS (SELECT max(idx) AS m FROM edges) SELECT {K}, i, j, 1 AS change FROM edges x WHERE idx > 0 AND NOT EXISTS (SELECT 1 FROM edges y WHERE {BEFORE}) UNION ALL SELECT ensemble_id, replica, idx + 1 AS idx, i, j, -1 FROM edges x, last WHERE idx < m AND NOT EXISTS (SELECT 1 FROM edges y WHERE {AFTER})")
def t2(spark, d):
    return N.bond_changes(edges(spark, d)).select(*KEY, "i", "j", "change")


@query("T3_bond_creation", f"{GRAPH} SELECT {K}, count(*) AS created FROM edges x WHERE idx > 0 AND NOT EXISTS (SELECT 1 FROM edges y WHERE {BEFORE}) GROUP BY ALL")
def t3(spark, d):
    return N.bond_changes(edges(spark, d)).where("change = 1").groupBy(*KEY).agg(F.count("*").alias("created"))


@query("T6_stable_defects", f"{GRAPH}, {BODY_SQL}, z AS (SELECT {K}, i AS pid, count(*) AS z FROM e2 GROUP BY ALL) SELECT a.ensemble_id, a.replica, a.idx, count(*) AS stable FROM z a JOIN bod m ON a.ensemble_id = m.ensemble_id AND a.replica = m.replica AND a.idx = m.idx AND a.pid = m.pid JOIN z b ON a.ensemble_id = b.ensemble_id AND a.replica = b.replica AND a.pid = b.pid AND b.idx = a.idx + 1 WHERE body AND a.z != 6 AND a.z = b.z GROUP BY ALL")
def t6(spark, d):
    z = N.both_ways(edges(spark, d).select(*KEY, "i", "j")).groupBy(*KEY, F.col("i").alias("pid")).agg(F.count("*").alias("z"))
    later = z.select("ensemble_id", "replica", (F.col("idx") - 1).alias("idx"), "pid", F.col("z").alias("z_next"))
    met = z.join(body(spark, d).where("body"), [*KEY, "pid"]).join(later, [*KEY, "pid"])
    return met.where("z != 6 and z = z_next").groupBy(*KEY).agg(F.count("*").alias("stable"))


@query("T1_state_distance", f"{BASE}, l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt FROM particles WINDOW w AS (PARTITION BY ensemble_id, replica, pid ORDER BY idx)) SELECT {K}, round(sqrt(sum(dx*dx + dy*dy + dt*dt))/sqrt(count(*)), 6) AS distance FROM l WHERE dx IS NOT NULL GROUP BY ALL")
def t1(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("ensemble_id", "replica", "pid").orderBy("idx")
    rows = A.particles(spark, d).select(*KEY, *[(F.col(c) - F.lag(c).over(w)).alias(f"d{c}") for c in "xyt"]).where("dx is not null")
    total = reduce(lambda a, b: a + b, [F.col(f"d{c}") * F.col(f"d{c}") for c in "xyt"])
    return rows.groupBy(*KEY).agg(r(F.sqrt(F.sum(total)) / F.sqrt(F.count("*"))).alias("distance"))


SM = f"{BASE}, f AS (SELECT *, cos(2*t) + 2 AS u, abs(x) + 1 AS v FROM particles)"


@query("P1_pair_correlation", f"""{SM}, m AS (SELECT *, avg(u) OVER w AS mu, avg(v) OVER w AS mv FROM f WINDOW w AS (PARTITION BY {K})) SELECT p.ensemble_id, p.replica, p.idx, p.pid AS pid_i, q.pid AS pid_j, round({RPQ}, 6) AS r,
round(0.5/(p.mu*p.mv)*((p.u - p.mu)*(q.v - q.mv) + (q.u - q.mu)*(p.v - p.mv)), 6) + 0.0 AS c FROM m p JOIN m q ON p.ensemble_id = q.ensemble_id AND p.replica = q.replica AND p.idx = q.idx AND p.pid <= q.pid""")
def p1(spark, d):
    f = A.particles(spark, d).withColumn("u", F.cos(2 * F.col("t")) + 2).withColumn("v", F.abs("x") + 1)
    return rounded(P.pair_correlation(f, "u", "v"), "r", "c")


@query("P2_ensemble_correlation", f"""{SM}, m AS (SELECT *, avg(u) OVER w AS mu, avg(v) OVER w AS mv FROM f WINDOW w AS (PARTITION BY ensemble_id, idx)) SELECT p.ensemble_id, p.replica, p.idx, count(*) AS pairs, round(sum(0.5/(p.mu*p.mv)*((p.u - p.mu)*(q.v - q.mv) + (q.u - q.mu)*(p.v - p.mv))), 5) + 0.0 AS c
FROM m p JOIN m q ON p.ensemble_id = q.ensemble_id AND p.replica = q.replica AND p.idx = q.idx AND p.pid <= q.pid GROUP BY ALL""")
def p2(spark, d):
    f = A.particles(spark, d).withColumn("u", F.cos(2 * F.col("t")) + 2).withColumn("v", F.abs("x") + 1)
    return rounded(P.correlation_sums(f, "u", "v", ["ensemble_id", "idx"]), "c", digits=5)


ANGULAR = f"{BASE}, c AS (SELECT p.ensemble_id, p.replica, p.idx, {RPQ} AS r, cos(2*(p.t - q.t)) AS c {PAIRS} AND p.pid <= q.pid)"


@query("P3_P5_binned_angular", f"{ANGULAR}, m AS (SELECT {K}, min(r) AS lo, max(r) AS hi FROM c GROUP BY ALL), b AS (SELECT c.*, lo, hi, CAST(floor((r - 1e-6 - lo)/((hi - lo)/50)) AS INTEGER) AS bin FROM c JOIN m USING ({K})) SELECT {K}, bin, round(min(lo) + (bin + 0.5)*(min(hi - lo)/50) + 1e-6, 6) AS x, round(avg(c), 6) + 0.0 AS y FROM b WHERE bin BETWEEN 0 AND 49 GROUP BY {K}, bin")
def p3(spark, d):
    return rounded(P.pair_bins(A.particles(spark, d), ["x", "y", "t"], P.aligned, 50), "x", "y")


@query("P4_rod_pair_distance", f"{BASE} SELECT {PK}, round(avg({segdist_sql('(1 - 1/1.7)', 'p', 'q')}), 5) AS mean_rod, round(avg({RPQ}), 5) AS mean_centre {PAIRS} AND p.pid < q.pid GROUP BY {PK}")
def p4(spark, d):
    f = A.particles(spark, d).withColumn("gamma", F.lit(1.7))
    rows = P.pair_means(f, ["x", "y", "t", "gamma"], {"mean_rod": P.rods, "mean_centre": P.centres}).where("pairs > 0")
    return rounded(rows.drop("pairs"), "mean_rod", "mean_centre", digits=5)
