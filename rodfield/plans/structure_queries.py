"""Queries on the structure of the neighbour graph, each with equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.functions import columns as C
from rodfield.operators import delaunay as T
from rodfield.operators import graph as N
from rodfield.operators import select as B
from rodfield.operators import structure as S
from rodfield.plans.base_queries import BASE, K, r, rounded
from rodfield.plans.graph_queries import BODY_SQL, BOUNDARY_SQL, GRAPH, ORDERS_SQL, _vote_sql, body, bonds, edges, orders, particles, report, triangles
from rodfield.plans.lineage import shared
from rodfield.sources import adapters as A

QUERIES, ORACLES = {}, {}
RGRAPH = GRAPH.replace("WITH ", "WITH RECURSIVE ", 1)


R_PHI = "CASE WHEN phi < 0.9 THEN (phi - 0.4)/(0.9 - 0.4)*0.9/phi ELSE 1 END"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def on(p: str, q: str) -> str:
    return f"{p}.ensemble_id = {q}.ensemble_id AND {p}.replica = {q}.replica AND {p}.idx = {q}.idx"


def keys(p: str) -> str:
    return f"{p}.ensemble_id, {p}.replica, {p}.idx"


RANK_SQL = f"""yw AS (SELECT p.ensemble_id, p.replica, p.idx, p.pid, abs(y) AS h, n, b, {R_PHI} AS rp, row_number() OVER (PARTITION BY {K} ORDER BY abs(y) DESC, pid) - 1 AS pos FROM particles p JOIN states USING ({K})),
yc AS (SELECT *, max(CASE WHEN pos = greatest(least(CAST(round_even(rp*n, 0) AS INTEGER), CAST(n AS INTEGER) - 1), 0) THEN h END) OVER (PARTITION BY {K}) AS c FROM yw), yr AS (SELECT {K}, pid, h >= b - 0.5*(b - c) AS y_rank FROM yc)"""


@query("B9_named_masks", f"""{ORDERS_SQL}, {BODY_SQL}, {RANK_SQL}, d0 AS (SELECT {K}, pid, CASE WHEN farthest < 2.05 THEN 2 WHEN farthest <= 3.4 THEN 1 ELSE 0 END AS l FROM orders), {_vote_sql('d0', 'd1')}
SELECT {K}, pid, body, NOT (abs(y) > 2*b/3 AND abs(y) < 5*b/6 AND abs(x) < a/2) AS internal, (abs(y) > 2*b/3 AND abs(y) < 5*b/6 AND abs(x) < a/2) AS boundary, bd.pid IS NOT NULL AS graph_boundary, y_rank, d1.l = 0 AS dense0, d1.l = 1 AS dense1, d1.l = 2 AS dense2
FROM particles JOIN states USING ({K}) LEFT JOIN bd USING ({K}, pid) JOIN bod USING ({K}, pid) JOIN yr USING ({K}, pid) JOIN d1 USING ({K}, pid)""")
def b9(spark, d):
    states = A.states(spark, d).select(*KEY, "a", "b", "phi")
    rows = B.y_rank_mask(particles(spark, d).join(states, KEY), C.r_phi("phi") * F.col("n"))
    edge = N.graph_boundary(edges(spark, d)).withColumn("edge", F.lit(True))
    dense = N.dense_variants(orders(spark, d), edges(spark, d)).select(*KEY, "pid", "dense")
    rows = rows.join(edge, [*KEY, "pid"], "left").join(body(spark, d), [*KEY, "pid"]).join(dense, [*KEY, "pid"])
    masks = {"internal": B.internal_window(), "boundary": ~B.internal_window(), "graph_boundary": F.coalesce("edge", F.lit(False))} | {f"dense{n}": F.col("dense") == n for n in (0, 1, 2)}
    return rows.select(*KEY, "pid", "body", "y_rank", *[m.alias(n) for n, m in masks.items()])


#: Arc lengths summed over a fine grid, and the grid's cell that each point's arc ends in.
ARCS_SQL = f"""{BASE}, ax AS (SELECT {K}, a + 1/gamma AS one, b + 1/gamma AS two FROM states), ay AS (SELECT *, greatest(one, two) AS p, least(one, two) AS q, one < two AS turned FROM ax),
gr AS (SELECT {K}, p, q, turned, k, sqrt(p*sin(2*pi()*(k + 0.5)/8192)*p*sin(2*pi()*(k + 0.5)/8192) + q*cos(2*pi()*(k + 0.5)/8192)*q*cos(2*pi()*(k + 0.5)/8192))*2*pi()/8192 AS ds FROM ay, range(8192) g(k)),
cu AS (SELECT *, sum(ds) OVER (PARTITION BY {K} ORDER BY k) - ds + pow(2*pi()/8192, 2)/24*(p*p - q*q)*sin(2*pi()*k/8192)*cos(2*pi()*k/8192)/sqrt(p*sin(2*pi()*k/8192)*p*sin(2*pi()*k/8192) + q*cos(2*pi()*k/8192)*q*cos(2*pi()*k/8192)) AS s, sum(ds) OVER (PARTITION BY {K}) AS total FROM gr),
tg AS (SELECT {K}, CAST(g AS INTEGER) AS g, total*g/n AS goal FROM (SELECT DISTINCT {K}, total, CAST(round_even(total/0.1, 0) AS INTEGER) AS n FROM (SELECT {K}, max(total) AS total FROM cu GROUP BY ALL)), range(4000) r(g) WHERE g < n),
m0 AS (SELECT tg.*, p, q, turned, goal - s AS rest, 2*pi()*k/8192 AS t0, 2*pi()*(k + (goal - s)/ds/2)/8192 AS half FROM tg ASOF JOIN cu ON tg.ensemble_id = cu.ensemble_id AND tg.replica = cu.replica AND tg.idx = cu.idx AND tg.goal >= cu.s),
mt AS (SELECT *, t0 + rest/sqrt(p*sin(half)*p*sin(half) + q*cos(half)*q*cos(half)) AS t FROM m0)
SELECT {K}, g, round(CASE WHEN turned THEN -q*sin(t) ELSE p*cos(t) END, 4) + 0.0 AS x, round(CASE WHEN turned THEN p*cos(t) ELSE q*sin(t) END, 4) + 0.0 AS y FROM mt"""


@query("C3_ellipse_points", ARCS_SQL)
def c3(spark, d):
    return rounded(S.ellipse_points(A.states(spark, d)), "x", "y", digits=4)


def rod_triangles(spark, d):
    """Triangles of the disks along all rods and the ellipse around each state; built once a session."""
    return shared(spark, d, "rod_triangles", lambda: T.triangulate(S.disk_points(particles(spark, d), A.states(spark, d))))


def rod_edges(spark, d):
    return shared(spark, d, "rod_edges", lambda: S.rod_edges(rod_triangles(spark, d)))


def rod_orders(spark, d):
    return shared(spark, d, "rod_orders", lambda: N.order_parameters(particles(spark, d), rod_edges(spark, d)))


@query("C5_C8_edge_types")
def c8(spark, d):
    """The graph of rods by the contacts of their disks. Tested against brute force; too many points for SQL."""
    rows = rod_edges(spark, d).join(A.states(spark, d).select(*KEY, "gamma"), KEY)
    return S.edge_types(rows, F.floor(1 + 2 * (F.col("gamma") - 1) / 0.1 + 1e-9)).select(*KEY, "i", "j", "w", "type")


@query("D28_rod_orders")
def d28(spark, d):
    """All order parameters on the graph of rods."""
    rows = rod_orders(spark, d)
    return rows.select(*KEY, "pid", *[r(c).alias(c) if k == "double" else c for c, k in rows.dtypes if c not in (*KEY, "pid", "x", "y", "t", "gamma", "n") and not k.startswith("struct")])


@query("G6_rod_report")
def g6_rods(spark, d):
    """Means of the seven order parameters on the graph of rods."""
    return report(rod_orders(spark, d), A.particles(spark, d))


def _cos(o: str, u: str, v: str) -> str:
    a, b, c, e = f"({u}.x - {o}.x)", f"({u}.y - {o}.y)", f"({v}.x - {o}.x)", f"({v}.y - {o}.y)"
    return f"coalesce(({a}*{c} + {b}*{e})/nullif(sqrt(({a}*{a} + {b}*{b})*({c}*{c} + {e}*{e})), 0), -1)"


SAME = "g.ensemble_id = s.ensemble_id AND g.replica = s.replica AND g.idx = s.idx"


@query("C6_without_slivers", f"""{RGRAPH}, inner_ AS (SELECT * FROM tri WHERE a >= 0), fl AS (SELECT t.*, least({_cos('p', 'q', 's')}, {_cos('q', 'p', 's')}, {_cos('s', 'p', 'q')}) < -0.9 AS flat
FROM inner_ t JOIN particles p ON {on('t', 'p')} AND t.a = p.pid JOIN particles q ON {on('t', 'q')} AND t.b = q.pid JOIN particles s ON {on('t', 's')} AND t.c = s.pid),
sd AS (SELECT *, a AS i, b AS j FROM fl UNION ALL SELECT *, a, c FROM fl UNION ALL SELECT *, b, c FROM fl), hull AS (SELECT {K}, i, j FROM sd GROUP BY ALL HAVING count(*) = 1),
gone AS (SELECT {keys('sd')}, a, b, c FROM sd JOIN hull USING ({K}, i, j) WHERE flat UNION SELECT {keys('s')}, s.a, s.b, s.c FROM gone g JOIN sd f ON {on('f', 'g')} AND f.a = g.a AND f.b = g.b AND f.c = g.c JOIN sd s ON {SAME} AND s.i = f.i AND s.j = f.j AND s.flat)
SELECT {K}, a, b, c FROM inner_ t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE {on('g', 't')} AND g.a = t.a AND g.b = t.b AND g.c = t.c)""")
def c6(spark, d):
    return S.without_slivers(A.particles(spark, d), triangles(spark, d))


#: Least squares by orthogonal vectors: x^2, then what xy has beyond it, then what y^2 has beyond both.
D10_SQL = f"""{ORDERS_SQL}, f1 AS (SELECT *, dx*dx AS xx, dx*dy AS xy, dy*dy AS yy FROM bonds), f2 AS (SELECT *, sum(xx*xx) OVER w AS d1, sum(xy*xx) OVER w/sum(xx*xx) OVER w AS c12, sum(yy*xx) OVER w/sum(xx*xx) OVER w AS c13, sum(xx) OVER w AS b1, count(*) OVER w AS n FROM f1 WINDOW w AS (PARTITION BY {K}, i)),
f3 AS (SELECT *, xy - c12*xx AS v2, yy - c13*xx AS w3 FROM f2), f4 AS (SELECT *, nullif(sum(v2*v2) OVER w, 0) AS d2, sum(w3*v2) OVER w/nullif(sum(v2*v2) OVER w, 0) AS c23, sum(v2) OVER w AS b2 FROM f3 WINDOW w AS (PARTITION BY {K}, i)),
f5 AS (SELECT *, w3 - c23*v2 AS v3 FROM f4), f6 AS (SELECT *, sum(v3) OVER w/nullif(sum(v3*v3) OVER w, 0) AS r FROM f5 WINDOW w AS (PARTITION BY {K}, i)), f7 AS (SELECT *, b2/d2 - c23*r AS q FROM f6), f8 AS (SELECT *, b1/d1 - c12*q - c13*r AS p FROM f7),
f9 AS (SELECT *, n >= 3 AND coalesce(p + r > 0 AND 4*p*r > q*q, false) AS valid, (p + r - sqrt((p - r)*(p - r) + q*q))/2 AS low, (p + r + sqrt((p - r)*(p - r) + q*q))/2 AS top FROM f8),
fa AS (SELECT *, CASE WHEN abs(low - r) > abs(low - p) THEN atan2(q/2, low - r) ELSE atan2(low - p, q/2) END AS th FROM f9),
tw AS (SELECT {K}, i AS pid, gamma, valid, CASE WHEN valid THEN sqrt(top/low) END AS g, CASE WHEN valid THEN atan2(sqrt(top/low)*(-dx*sin(th) + dy*cos(th)), dx*cos(th) + dy*sin(th)) END AS w FROM fa)
SELECT {K}, pid, round(CASE WHEN NOT valid OR g > gamma THEN 0 ELSE sqrt(avg(cos(6*w))*avg(cos(6*w)) + avg(sin(6*w))*avg(sin(6*w))) END, 4) + 0.0 AS fitted FROM tw GROUP BY {K}, pid, valid, g, gamma"""


@query("D10_fitted_elliptic_phi6", D10_SQL)
def d10(spark, d):
    return S.fitted_elliptic_phi6(bonds(spark, d)).select(*KEY, "pid", r("order", 4).alias("fitted"))


def _round_sql(old: str, new: str) -> str:
    return f"""{new}s AS (SELECT {K}, pid, sum(cos(2*t)) AS c, sum(sin(2*t)) AS s FROM (SELECT {K}, pid, t FROM {old} UNION ALL SELECT {keys('e')}, e.i, o.t FROM e2 e JOIN {old} o ON {on('e', 'o')} AND e.j = o.pid) GROUP BY ALL),
{new} AS (SELECT {K}, pid, atan2(s, c + sqrt(c*c + s*s)) - pi()*floor(atan2(s, c + sqrt(c*c + s*s))/pi()) AS t FROM {new}s)"""


@query("D15_director_2", f"{GRAPH}, {_round_sql('particles', 'one')}, {_round_sql('one', 'two')} SELECT {K}, pid, round(t, 5) AS director FROM two")
def d15(spark, d):
    return S.director(A.particles(spark, d), edges(spark, d), 2).select(*KEY, "pid", r("angle", 5).alias("director"))


def _step(u: str, v: str) -> str:
    return f"(CASE WHEN {v} - {u} > 0.5 THEN {v} - {u} - 1 WHEN {v} - {u} < -0.5 THEN {v} - {u} + 1 ELSE {v} - {u} END)"


@query("D21_axis_defects", f"""{GRAPH}, rt AS (SELECT {keys('x')}, x.i AS a, x.j AS b, y.j AS c FROM edges x JOIN edges y ON {on('x', 'y')} AND x.j = y.i JOIN edges z ON {on('x', 'z')} AND x.i = z.i AND y.j = z.j),
cn AS (SELECT t.*, p.x AS px, p.y AS py, p.t/pi() AS u FROM rt t JOIN particles p ON {on('t', 'p')} AND p.pid IN (t.a, t.b, t.c)), ce AS (SELECT *, avg(px) OVER w AS mx, avg(py) OVER w AS my FROM cn WINDOW w AS (PARTITION BY {K}, a, b, c)),
li AS (SELECT {K}, a, b, c, list(u ORDER BY atan2(py - my, px - mx)) AS l FROM ce GROUP BY ALL), st AS (SELECT {K}, {_step('l[1]', 'l[2]')} AS s1, {_step('l[2]', 'l[3]')} AS s2, {_step('l[3]', 'l[1]')} AS s3 FROM li),
wd AS (SELECT {K}, CAST(round(s1 + s2 + s3) AS INTEGER) AS w FROM st WHERE abs(abs(s1) - 0.5) > 1e-4 AND abs(abs(s2) - 0.5) > 1e-4 AND abs(abs(s3) - 0.5) > 1e-4)
SELECT {K}, count(*) FILTER (w > 0) AS positive, count(*) FILTER (w < 0) AS negative FROM wd WHERE w != 0 GROUP BY ALL""")
def d21(spark, d):
    found = S.axis_defects(A.particles(spark, d), S.rod_triangles(edges(spark, d)))
    return found.groupBy(*KEY).agg(F.count(F.when(F.col("winding") > 0, 1)).alias("positive"), F.count(F.when(F.col("winding") < 0, 1)).alias("negative"))


@query("D23_segment_rank_mask", f"""{ORDERS_SQL}, rk AS (SELECT o.ensemble_id, o.replica, o.idx, o.pid, farthest AS l, s.n, {R_PHI} AS rp, row_number() OVER (PARTITION BY {keys('o')} ORDER BY farthest, o.pid) - 1 AS pos FROM orders o JOIN states s ON {on('o', 's')}),
th AS (SELECT *, max(CASE WHEN pos = greatest(least(round_even(n*rp, 0), n - 1), 0) THEN l END) OVER (PARTITION BY {K}) AS c FROM rk), v0 AS MATERIALIZED (SELECT {K}, pid, CAST(l <= c AS INTEGER) AS l FROM th),
{_vote_sql('v0', 'v1')}, {_vote_sql('v1', 'v2')}, {_vote_sql('v2', 'v3')}, {_vote_sql('v3', 'v4')} SELECT {K}, pid, CASE WHEN rp >= 1 THEN 1 ELSE l END AS flag FROM v4 JOIN (SELECT {K}, pid, rp FROM rk) USING ({K}, pid)""")
def d23(spark, d):
    return S.segment_rank_mask(orders(spark, d), edges(spark, d), A.states(spark, d))


@query("D27_misalignment", f"""{GRAPH}, zz AS (SELECT {K}, i AS pid, count(*) AS z FROM e2 GROUP BY ALL), u AS (SELECT {keys('e')}, abs(p.t - q.t)/pi() - floor(abs(p.t - q.t)/pi()) AS u FROM e2 e JOIN zz a ON {on('e', 'a')} AND e.i = a.pid AND a.z = 5
JOIN zz b ON {on('e', 'b')} AND e.j = b.pid AND b.z = 7 JOIN particles p ON {on('e', 'p')} AND e.i = p.pid JOIN particles q ON {on('e', 'q')} AND e.j = q.pid) SELECT {K}, CAST(least(floor(least(u, 1 - u)*2*90), 89) AS INTEGER) AS bin, count(*) AS count FROM u GROUP BY ALL""")
def d27(spark, d):
    rows = bonds(spark, d)
    return S.misalignment(rows, rows.groupBy(*KEY, F.col("i").alias("pid")).agg(F.count("*").alias("z")))


EVENTS_SQL = f"""{RGRAPH}, {BODY_SQL}, zc AS (SELECT {K}, i AS pid, count(*) AS z FROM e2 GROUP BY ALL), zz AS (SELECT {K}, p.pid, CASE WHEN NOT body THEN 6 ELSE coalesce(z, 0) END AS z FROM bod p LEFT JOIN zc USING ({K}, pid)),
nb AS (SELECT * FROM edges e WHERE idx > 0 AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.ensemble_id = e.ensemble_id AND o.replica = e.replica AND o.idx = e.idx - 1 AND o.i = e.i AND o.j = e.j)),
vx AS (SELECT DISTINCT {K}, unnest([i, j]) AS pid FROM nb), rc AS (SELECT {K}, pid, pid AS root FROM vx UNION SELECT {keys('e')}, e.j, rc.root FROM rc JOIN e2 e ON {on('e', 'rc')} AND e.i = rc.pid JOIN vx v ON {on('v', 'e')} AND v.pid = e.j WHERE rc.root < e.j),
lb AS (SELECT {K}, pid, min(root) AS label FROM rc GROUP BY ALL), ev AS (SELECT l.ensemble_id, l.replica, l.idx, label, count(*) AS size, CAST(sum(greatest(6 - b.z, 0)) AS BIGINT) AS prev_neg, CAST(sum(greatest(b.z - 6, 0)) AS BIGINT) AS prev_pos, CAST(sum(greatest(6 - n.z, 0)) AS BIGINT) AS cur_neg, CAST(sum(greatest(n.z - 6, 0)) AS BIGINT) AS cur_pos
FROM lb l JOIN zz n ON {on('n', 'l')} AND n.pid = l.pid JOIN zz b ON b.ensemble_id = l.ensemble_id AND b.replica = l.replica AND b.idx = l.idx - 1 AND b.pid = l.pid GROUP BY ALL)"""


def events(spark, d):
    return shared(spark, d, "events", lambda: S.rearrangements(body(spark, d), edges(spark, d)))


@query("T4_rearrangements", f"{EVENTS_SQL} SELECT * FROM ev")
def t4(spark, d):
    return events(spark, d)


@query("T5_event_sizes", f"{EVENTS_SQL} SELECT {K}, CAST(least((size + 1)//2, 9) AS INTEGER) AS bin, count(*) AS count FROM ev GROUP BY ALL")
def t5(spark, d):
    return S.event_sizes(events(spark, d), 10)


SCAN_SQL = f"""{ORDERS_SQL}, tr AS (SELECT {keys("b")}, b.i AS pid, CAST(1 + k*0.05 AS DOUBLE) AS trial, atan2((1 + k*0.05)*(-dx*sin(director) + dy*cos(director)), dx*cos(director) + dy*sin(director)) AS w FROM bonds b JOIN orders o ON {on('b', 'o')} AND b.i = o.pid, range(21) g(k)),
pp AS (SELECT {K}, pid, trial, sqrt(avg(cos(6*w))*avg(cos(6*w)) + avg(sin(6*w))*avg(sin(6*w))) AS o FROM tr GROUP BY ALL), sc AS (SELECT {K}, trial, avg(o) AS o FROM pp GROUP BY ALL)"""


def directors(spark, d):
    return orders(spark, d).select(*KEY, "pid", F.col("DirectorAngle").alias("angle"))


def scan(spark, d):
    return S.gamma_scan(bonds(spark, d), directors(spark, d), 21)


@query("R12_gamma_landscape", f"{SCAN_SQL} SELECT {K}, round(trial, 6) AS trial, round(o, 6) AS \"order\" FROM sc")
def r12(spark, d):
    return rounded(scan(spark, d), "trial", "order")


@query("R12_best_gamma", f"{SCAN_SQL} SELECT {K}, round(trial, 6) AS trial, round(o, 6) AS \"order\" FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY o DESC, trial) AS pos FROM sc) WHERE pos = 1")
def r12_best(spark, d):
    return rounded(S.best_gamma(scan(spark, d)), "trial", "order")


#: The normal equations of the cubic with trials from -1 to 1 are solved by orthogonal polynomials of the 21 places.
CUBIC_SQL = f"""{SCAN_SQL}, qs AS (SELECT {K}, trial, (trial - 1.5)*20 AS u, -o AS y FROM sc), pl AS (SELECT {K}, trial, y, 1.0 AS p0, u AS p1, u*u - 110.0/3 AS p2, u*u*u - 65.8*u AS p3 FROM qs),
cf AS (SELECT {K}, sum(y*p0)/sum(p0*p0) AS k0, sum(y*p1)/sum(p1*p1) AS k1, sum(y*p2)/sum(p2*p2) AS k2, sum(y*p3)/sum(p3*p3) AS k3 FROM pl GROUP BY ALL),
cv AS (SELECT {K}, k3 AS a3, k2 AS a2, k1 - 65.8*k3 AS a1, k0 - 110.0/3*k2 AS a0 FROM cf),
ro AS (SELECT *, CASE WHEN (a2*a2 - 3*a3*a1)*160000 > 1e-6 AND abs(a3)*8000 > 1e-6 THEN (-a2 + sqrt(a2*a2 - 3*a3*a1))/(3*a3) END AS z, ((a3*-10 + a2)*-10 + a1)*-10 + a0 AS y_low, ((a3*10 + a2)*10 + a1)*10 + a0 AS y_high FROM cv),
bt AS (SELECT {K}, 1.5 + (CASE WHEN z BETWEEN -10 AND 10 THEN z WHEN y_low < y_high THEN -10 ELSE 10 END)/20 AS trial FROM ro),
tb AS (SELECT {keys("b")}, b.i AS pid, trial, atan2(trial*(-dx*sin(director) + dy*cos(director)), dx*cos(director) + dy*sin(director)) AS w FROM bonds b JOIN orders o ON {on('b', 'o')} AND b.i = o.pid JOIN bt ON {on('b', 'bt')})
SELECT {K}, round(any_value(trial), 4) AS trial, round(avg(o), 4) AS "order" FROM (SELECT {K}, pid, trial, sqrt(avg(cos(6*w))*avg(cos(6*w)) + avg(sin(6*w))*avg(sin(6*w))) AS o FROM tb GROUP BY ALL) GROUP BY {K}"""


@query("R12_cubic_gamma", CUBIC_SQL)
def r12_cubic(spark, d):
    return rounded(S.best_gamma_cubic(bonds(spark, d), directors(spark, d)), "trial", "order", digits=4)


@query("R12_star_gamma", f"""{ORDERS_SQL}, ts AS (SELECT {keys("b")}, b.i AS pid, atan2(b.gamma*sqrt(3)/2*(-dx*sin(director) + dy*cos(director)), dx*cos(director) + dy*sin(director)) AS w FROM bonds b JOIN orders o ON {on('b', 'o')} AND b.i = o.pid)
SELECT {K}, round(avg(o), 6) AS "order" FROM (SELECT {K}, pid, sqrt(avg(cos(6*w))*avg(cos(6*w)) + avg(sin(6*w))*avg(sin(6*w))) AS o FROM ts GROUP BY ALL) GROUP BY ALL""")
def r12_star(spark, d):
    """Mean elliptic order at the ratio that follows from the rods' own."""
    rows = bonds(spark, d).join(directors(spark, d).withColumnRenamed("pid", "i"), [*KEY, "i"])
    return S.turned_order(rows, F.col("angle"), C.gamma_star("gamma")).groupBy(*KEY).agg(r(F.avg("order")).alias("order"))
