"""Queries on sources, selection, simple order parameters and aggregates, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.functions import columns as C
from rodfield.functions.student import t_table
from rodfield.operators import aggregate as G
from rodfield.operators import order as D
from rodfield.operators import select as B
from rodfield.sources import adapters as A

QUERIES, ORACLES = {}, {}

K = "ensemble_id, replica, idx"
E = lambda n: f"CAST(embedding[3*k+{n + 1}] AS DOUBLE)"


def particles_sql(frames: int = A.FRAMES) -> str:
    return f"""particles AS (SELECT 'e' || (label % 2) AS ensemble_id, CAST(label // 2 AS INTEGER) AS replica, CAST(k AS INTEGER) AS idx, vec_id AS pid,
  40*{E(0)} AS x, 40*{E(1)} AS y, 10*{E(2)} - pi()*floor(10*{E(2)}/pi()) AS t FROM embeddings, range({frames}) r(k))"""


STATES_SQL = """states0 AS (SELECT ensemble_id, replica, idx, count(*) AS n, max(abs(x)) + 2 AS a, max(abs(y)) + 2 AS b, sqrt(max(x*x + y*y)) + 2 AS ring_r FROM particles GROUP BY ALL),
states1 AS (SELECT *, CASE WHEN ensemble_id = 'e0' THEN 1.2 ELSE 1.7 END::DOUBLE AS gamma, n/(pi()*a*b) AS rho FROM states0),
states AS (SELECT *, rho*(pi() + 4*(gamma - 1))/(gamma*gamma) AS phi FROM states1)"""
BASE = f"WITH {particles_sql()}, {STATES_SQL}"
CURVES_SQL = """curves AS (SELECT event_type AS ensemble_id, CAST(user_id % 5 AS INTEGER) AS replica, CAST(floor((floor(epoch(ts)) - 1704067200)/21600) AS INTEGER) AS idx,
  avg(value) AS y, CAST(floor((floor(epoch(ts)) - 1704067200)/21600) AS DOUBLE) AS x FROM events GROUP BY 1, 2, 3, 5)"""
PROPS_SQL = """props AS (SELECT l_suppkey AS ensemble_id, l_linenumber AS replica, CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS idx,
  l_extendedprice AS max_gradient, l_discount AS energy, l_tax AS mean_gradient, l_quantity AS n FROM lineitem)"""
T_SQL = f"tq AS (SELECT unnest(range(1, 201)) AS dof, unnest({t_table()!r}) AS q)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(c, digits: int = 6):
    """Rounded for comparison, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


@query("A1_load_states", f"{BASE} SELECT {K}, n, round(a, 6) AS a, round(b, 6) AS b, gamma, round(rho, 6) AS rho, round(phi, 6) AS phi FROM states")
def a1(spark, d):
    return rounded(A.states(spark, d), "a", "b", "rho", "phi").select(*KEY, "n", "a", "b", "gamma", "rho", "phi")


@query("A2_ensemble_summary", f"{BASE} SELECT ensemble_id, min(gamma) AS gamma, max(idx) + 1 AS n_states FROM states GROUP BY 1")
def a2(spark, d):
    return B.ensemble_summary(A.states(spark, d), ["gamma"])


@query("A3_truncate_common", f"WITH {CURVES_SQL}, e AS (SELECT ensemble_id, replica, max(idx) AS m FROM curves GROUP BY 1, 2), c AS (SELECT ensemble_id, min(m) AS m FROM e GROUP BY 1) SELECT ensemble_id, replica, idx, round(y, 6) AS y FROM curves JOIN c USING (ensemble_id) WHERE idx <= m")
def a3(spark, d):
    return rounded(B.truncate_common(A.curves(spark, d)), "y").select(*KEY, "y")


@query("A10_merge_runs", f"""WITH {CURVES_SQL}, u AS (SELECT 0 AS run, * FROM curves UNION ALL SELECT 1, * FROM curves WHERE replica < 2)
SELECT ensemble_id, CAST(dense_rank() OVER (PARTITION BY ensemble_id ORDER BY run, replica) - 1 AS INTEGER) AS replica, idx, round(y, 6) AS y FROM u""")
def a10(spark, d):
    c = A.curves(spark, d)
    both = c.withColumn("run", F.lit(0)).unionByName(c.where("replica < 2").withColumn("run", F.lit(1)))
    return rounded(B.renumber_replicas(both, ["ensemble_id"], ["run", "replica"]), "y").select(*KEY, "y")


@query("A11_drop_padded_tail", f"""WITH {CURVES_SQL}, g AS (SELECT DISTINCT ensemble_id, replica FROM curves), full_ AS (SELECT g.*, CAST(i AS INTEGER) AS idx FROM g, range(120) t(i)),
p AS (SELECT f.*, y FROM full_ f LEFT JOIN curves USING ({K})), w AS (SELECT *, min(CASE WHEN y IS NULL THEN idx END) OVER (PARTITION BY ensemble_id, replica) AS bad FROM p)
SELECT {K}, round(y, 6) AS y FROM w WHERE bad IS NULL OR idx < bad""")
def a11(spark, d):
    c = A.curves(spark, d)
    grid = c.select("ensemble_id", "replica").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(119))))
    return rounded(B.clean_prefix(grid.join(c.drop("x"), KEY, "left"), "y"), "y")


@query("A7_wide_curves", f"""{BASE}, {T_SQL}, m AS (SELECT gamma, idx, avg(phi) AS mean, stddev_samp(phi) AS s, count(phi) AS c FROM states GROUP BY 1, 2), z AS (SELECT m.*, q*s/sqrt(c) AS ci FROM m LEFT JOIN tq ON dof = c - 1)
SELECT idx, round(max(mean) FILTER (WHERE gamma = 1.2), 6) AS "1.2_mean", round(max(ci) FILTER (WHERE gamma = 1.2), 6) AS "1.2_ci", round(max(mean) FILTER (WHERE gamma = 1.7), 6) AS "1.7_mean", round(max(ci) FILTER (WHERE gamma = 1.7), 6) AS "1.7_ci" FROM z GROUP BY idx""")
def a7(spark, d):
    m = G.replica_mean(A.states(spark, d), "phi", ["gamma", "idx"])
    return m.groupBy("idx").pivot("gamma", [1.2, 1.7]).agg(F.round(F.first("mean"), 6).alias("mean"), F.round(F.first("ci"), 6).alias("ci"))


@query("B1_find", "SELECT p_partkey AS id, p_size AS n, p_brand AS potential, p_retailprice AS phi0 FROM part WHERE abs(p_retailprice - 901.1) < 1e-6 OR (p_size = 11 AND p_brand = 'Brand#2')")
def b1(spark, d):
    s = A.simulations(spark, d)
    return B.find(s, phi0=901.1000000001).unionByName(B.find(s, n=11, potential="Brand#2")).distinct()


@query("B2_positional", f"WITH {CURVES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id, replica ORDER BY idx) AS f, row_number() OVER (PARTITION BY ensemble_id, replica ORDER BY idx DESC) AS l FROM curves) SELECT {K}, round(y, 6) AS y FROM w WHERE f = 3 OR l = 2")
def b2(spark, d):
    c = A.curves(spark, d)
    return rounded(B.at_index(c, 2).unionByName(B.at_index(c, -2)), "y").select(*KEY, "y").distinct()


@query("B3_property", f"WITH {PROPS_SQL} SELECT {K}, max_gradient/(n*n) AS normalized_gradient FROM props")
def b3(spark, d):
    return A.properties(spark, d).select(*KEY, (F.col("max_gradient") / (F.col("n") * F.col("n"))).alias("normalized_gradient"))


@query("B4_index_interval", f"""{BASE}, w AS (SELECT *, min(CASE WHEN phi > 0.22 THEN idx END) OVER (PARTITION BY ensemble_id, replica) AS lo, min(CASE WHEN phi > 0.36 THEN idx END) OVER (PARTITION BY ensemble_id, replica) AS hi FROM states)
SELECT {K}, round(phi, 6) AS phi FROM w WHERE idx >= lo AND (hi IS NULL OR idx < hi)""")
def b4(spark, d):
    return rounded(B.index_interval(A.states(spark, d), phi_c=0.22, upper_phi=0.36), "phi").select(*KEY, "phi")


@query("B5_derived_columns", f"""{BASE} SELECT {K}, round((pi() + 4*(gamma - 1))/(2*gamma*(2 - 0.5)), 6) AS reference_phi, round(gamma*sqrt(3)/2, 6) AS gamma_star,
round(CASE WHEN phi < 0.9 THEN (phi - 0.4)/(0.9 - 0.4)*0.9/phi ELSE 1 END, 6) AS r_phi, round((1 + gamma) - sqrt((gamma - 1)*(gamma - 1) + 1/rho), 6) AS h_ref, round(a/b, 6) AS ratio FROM states""")
def b5(spark, d):
    return A.states(spark, d).select(*KEY, r(C.reference_phi("gamma", 0.5)).alias("reference_phi"), r(C.gamma_star("gamma")).alias("gamma_star"), r(C.r_phi("phi")).alias("r_phi"), r(C.h_ref("gamma", "rho")).alias("h_ref"), r(F.col("a") / F.col("b")).alias("ratio"))


@query("B6_box_axes", f"{BASE} SELECT {K}, round(a/b*(sqrt(n*(pi() + 4*(gamma - 1))/(pi()*(a/b)*0.5))/gamma), 6) AS box_a, round(sqrt(n*(pi() + 4*(gamma - 1))/(pi()*(a/b)*0.5))/gamma, 6) AS box_b FROM states")
def b6(spark, d):
    a, b = C.box_axes("n", "gamma", 0.5, F.col("a") / F.col("b"))
    return A.states(spark, d).select(*KEY, r(a).alias("box_a"), r(b).alias("box_b"))


@query("B7_parameter_grid", f"{BASE} SELECT {K}, h, m FROM states, (SELECT unnest([0.1, 0.2, 0.4])::DOUBLE AS h), (SELECT unnest([1, 2]) AS m)")
def b7(spark, d):
    grid = B.parameter_grid(spark, h=[0.1, 0.2, 0.4], m=[1, 2])
    return A.states(spark, d).select(*KEY).crossJoin(F.broadcast(grid))


@query("B8_group_similar", "SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_size, p_brand) AS \"group\" FROM part")
def b8(spark, d):
    return B.group_similar(A.simulations(spark, d).withColumn("gap", F.lit(float("nan"))), ["n", "potential", "gap"]).select("id", "group")


@query("B10_mask_algebra", f"{BASE} SELECT {K}, pid FROM particles JOIN states USING ({K}) WHERE NOT (abs(y) > 2*b/3 AND abs(y) < 5*b/6 AND abs(x) < a/2) AND (x > 0 OR NOT y > 0)")
def b10(spark, d):
    p = A.particles(spark, d).join(A.states(spark, d), KEY)
    return p.where(B.mask_expression("window & (right | ~~~upper)", {"window": B.internal_window(), "right": F.col("x") > 0, "upper": F.col("y") > 0})).select(*KEY, "pid")


@query("B11_masked_mean", f"{BASE} SELECT {K}, round(avg(cos(2*t)), 6) AS \"S_x\" FROM particles JOIN states USING ({K}) WHERE abs(y) > 2*b/3 AND abs(y) < 5*b/6 AND abs(x) < a/2 GROUP BY ALL")
def b11(spark, d):
    p = D.s_x(A.particles(spark, d)).join(A.states(spark, d), KEY)
    return rounded(G.state_mean(p, ["S_x"], ~B.internal_window()).where("S_x is not null"), "S_x")


@query("B12_B13_apply_mask", f"WITH {particles_sql()} SELECT {K}, pid, round(CASE WHEN x > 0 THEN cos(2*t) ELSE 0 END, 6) + 0.0 AS zeroed, round(CASE WHEN x > 0 THEN cos(2*t) END, 6) + 0.0 AS shown, round(CASE WHEN NOT x > 0 THEN cos(2*t) END, 6) + 0.0 AS hidden FROM particles")
def b12(spark, d):
    p, m = D.s_x(A.particles(spark, d)), F.col("x") > 0
    return p.select(*KEY, "pid", r(B.zero_masked("S_x", m)).alias("zeroed"), r(B.null_masked("S_x", m)).alias("shown"), r(B.null_masked("S_x", m, True)).alias("hidden"))


@query("B14_geometric_masks", f"""{BASE} SELECT {K}, pid, CASE WHEN (0.9 - phi)/(0.9 - 0.4) <= 0 THEN false ELSE x*x/(a*a) + y*y/((b*((0.9 - phi)/(0.9 - 0.4)))*(b*((0.9 - phi)/(0.9 - 0.4)))) < 1 END AS inside,
NOT (abs(y) > 2*b/3 AND abs(y) < 5*b/6 AND abs(x) < a/2) AS window_ FROM particles JOIN states USING ({K})""")
def b14(spark, d):
    p = A.particles(spark, d).join(A.states(spark, d), KEY)
    return p.select(*KEY, "pid", B.inner_ellipse().alias("inside"), B.internal_window().alias("window_"))


@query("B15_worst_states", f"WITH {PROPS_SQL}, w AS (SELECT *, max_gradient/sqrt(n) AS v FROM props), o AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id ORDER BY v DESC, replica, idx) AS k FROM w) SELECT ensemble_id, round(v, 6) AS value, replica, idx FROM o WHERE k = 1")
def b15(spark, d):
    return rounded(B.worst_states(A.properties(spark, d), "max_gradient", size="n", power=0.5), "value")


P = f"WITH {particles_sql()}"


@query("D1_D2_angle", f"{P} SELECT {K}, pid, round(t - pi()*floor(t/pi()), 6) AS angle, round(cos(2*t), 6) + 0.0 AS s_x FROM particles")
def d1(spark, d):
    p = D.s_x(D.angle(A.particles(spark, d)))
    return p.select(*KEY, "pid", r("Angle").alias("angle"), r("S_x").alias("s_x"))


S_GLOBAL_SQL = f"""m AS (SELECT {K}, avg(cos(2*t)) AS c, avg(sin(2*t)) AS s FROM particles GROUP BY ALL),
sg AS (SELECT {K}, pid, cos(2*(t - atan2(s, c + sqrt(c*c + s*s)))) AS v FROM particles JOIN m USING ({K}))"""


@query("D3_s_global", f"{P}, {S_GLOBAL_SQL} SELECT {K}, pid, round(v, 6) + 0.0 AS s_global FROM sg")
def d3(spark, d):
    return D.s_global(A.particles(spark, d)).select(*KEY, "pid", r("S_global").alias("s_global"))


@query("D4_angle_histogram", f"{P} SELECT {K}, CAST(least(floor((t - pi()*floor(t/pi()))/pi()*180), 179) AS INTEGER) AS bin, count(*) AS count FROM particles GROUP BY ALL")
def d4(spark, d):
    return D.angle_histogram(A.particles(spark, d))


@query("D5_y_rank", f"""{BASE}, w AS (SELECT p.*, n, b, row_number() OVER (PARTITION BY {K} ORDER BY abs(y) DESC, pid) - 1 AS k FROM particles p JOIN states USING ({K})),
c AS (SELECT {K}, abs(y) AS c FROM w WHERE k = greatest(least(round_even(0.3*n, 0), n - 1), 0)) SELECT {K}, pid, abs(y) >= b - 0.5*(b - c) AS y_rank FROM w JOIN c USING ({K})""")
def d5(spark, d):
    p = A.particles(spark, d).join(A.states(spark, d), KEY)
    return B.y_rank_mask(p, 0.3 * F.col("n")).select(*KEY, "pid", "y_rank")


@query("G1_state_mean", f"{P}, {S_GLOBAL_SQL} SELECT {K}, round(avg(v), 6) AS s FROM sg GROUP BY ALL")
def g1(spark, d):
    return G.state_mean(D.s_global(A.particles(spark, d)), ["S_global"]).select(*KEY, r("S_global").alias("s"))


@query("G2_interval_series", f"{BASE}, {S_GLOBAL_SQL}, w AS (SELECT *, min(CASE WHEN phi > 0.22 THEN idx END) OVER (PARTITION BY ensemble_id, replica) AS lo FROM states) SELECT {K}, round(avg(v), 6) AS s FROM sg JOIN w USING ({K}) WHERE idx >= lo GROUP BY ALL")
def g2(spark, d):
    s = B.index_interval(A.states(spark, d), phi_c=0.22).select(*KEY)
    return rounded(G.state_mean(D.s_global(A.particles(spark, d).join(s, KEY)), ["S_global"]).withColumnRenamed("S_global", "s"), "s")


@query("G3_raw_curve", f"{BASE}, {S_GLOBAL_SQL} SELECT {K}, round(phi, 6) AS x, 'S_global' AS op, round(avg(v), 6) AS value FROM sg JOIN states USING ({K}) GROUP BY {K}, phi")
def g3(spark, d):
    m = G.state_mean(D.s_global(A.particles(spark, d)), ["S_global"]).join(A.states(spark, d).select(*KEY, "phi"), KEY)
    return rounded(G.to_curves(m, ["S_global"], "phi"), "x", "value")


NEMATIC_SQL = f"""{P}, {S_GLOBAL_SQL}, {T_SQL}, sm AS (SELECT {K}, avg(v) AS s FROM sg GROUP BY ALL), z AS (SELECT ensemble_id, idx, avg(s) AS mean, stddev_samp(s) AS sd, count(s) AS c FROM sm GROUP BY 1, 2)
SELECT ensemble_id, idx, round(mean, 6) AS mean, round(q*sd/sqrt(c), 6) AS ci FROM z LEFT JOIN tq ON dof = c - 1"""


@query("G4_nematic_order_ci", NEMATIC_SQL)
def nematic(spark, d):
    m = G.state_mean(D.s_global(A.particles(spark, d)), ["S_global"])
    return rounded(G.replica_mean(m, "S_global", ["ensemble_id", "idx"]), "mean", "ci")


CI_SQL = f"WITH {CURVES_SQL}, {T_SQL}, z AS (SELECT ensemble_id, idx, avg(y) AS mean, stddev_samp(y) AS sd, count(y) AS c FROM curves GROUP BY 1, 2), ci AS (SELECT ensemble_id, idx, mean, q*sd/sqrt(c) AS ci FROM z LEFT JOIN tq ON dof = c - 1)"


@query("G5_mean_energy", f"{CI_SQL} SELECT ensemble_id, idx, round(mean, 6) AS mean, round(ci, 6) AS ci FROM ci")
def g5(spark, d):
    return rounded(G.replica_mean(A.curves(spark, d), "y", ["ensemble_id", "idx"]), "mean", "ci")


@query("G7_stored_mean_ci", f"{CI_SQL} SELECT ensemble_id, 'y' AS op, CAST(idx AS DOUBLE) AS x, round(mean, 6) AS mean, round(ci, 6) AS ci FROM ci")
def g7(spark, d):
    stored = A.curves(spark, d).select(*KEY, "x", F.lit("y").alias("op"), F.col("y").alias("value"))
    return rounded(G.replica_mean(stored, "value", ["ensemble_id", "op", "x"]), "mean", "ci")


@query("G8_extract_truncated", f"{CI_SQL} SELECT ensemble_id, CAST(idx AS DOUBLE) AS x, round(mean, 6) AS mean, round(ci, 6) AS ci FROM ci WHERE idx < 60")
def g8(spark, d):
    m = G.replica_mean(A.curves(spark, d), "y", ["ensemble_id", "x"])
    return rounded(m.where("x < 60"), "mean", "ci")


@query("G9_sweep", f"{BASE} SELECT gamma, idx, round(sum(phi), 6) AS total, round(avg(phi), 6) AS average FROM states GROUP BY 1, 2")
def g9(spark, d):
    s = A.states(spark, d)
    return G.sweep(s, "phi", "sum").withColumnRenamed("phi", "total").join(G.sweep(s, "phi").withColumnRenamed("phi", "average"), ["gamma", "idx"]).select("gamma", "idx", r("total").alias("total"), r("average").alias("average"))


@query("G10_distribution", f"{P}, h AS (SELECT ensemble_id, idx, CAST(least(floor(sqrt(x*x + y*y)/8*100), 99) AS INTEGER) AS bin FROM particles WHERE sqrt(x*x + y*y) <= 8), c AS (SELECT ensemble_id, idx, bin, count(*) AS count FROM h GROUP BY ALL) SELECT ensemble_id, idx, bin, count, round(count/sum(count) OVER (PARTITION BY ensemble_id, idx)*100, 6) AS density FROM c")
def g10(spark, d):
    p = A.particles(spark, d).withColumn("v", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    return rounded(G.distribution(p, "v", 0.0, 8.0, 100, ["ensemble_id", "idx"]), "density")


@query("G11_log_histogram", f"WITH {PROPS_SQL}, l AS (SELECT replica, log10(max_gradient) AS l FROM props WHERE max_gradient > 0), m AS (SELECT replica, min(l) AS a, max(l) AS b FROM l GROUP BY 1) SELECT replica, CAST(least(floor((l - a)/(b - a)*50), 49) AS INTEGER) AS bin, count(*) AS count FROM l JOIN m USING (replica) GROUP BY 1, 2")
def g11(spark, d):
    return G.log_histogram(A.properties(spark, d), "max_gradient", 50, ["replica"])


@query("G13_two_order_scatter", f"{BASE}, {S_GLOBAL_SQL} SELECT {K}, round(avg(v), 6) AS first, round(phi, 6) AS second FROM sg JOIN states USING ({K}) GROUP BY {K}, phi")
def g13(spark, d):
    m = G.state_mean(D.s_global(A.particles(spark, d)), ["S_global"]).join(A.states(spark, d).select(*KEY, "phi"), KEY)
    return rounded(G.two_orders(G.to_curves(m, ["S_global", "phi"], "phi"), "S_global", "phi", KEY), "first", "second")


@query("G14_two_order_path", f"{BASE}, {S_GLOBAL_SQL}, sm AS (SELECT {K}, avg(v) AS s FROM sg GROUP BY ALL) SELECT ensemble_id, idx, round(avg(s), 6) AS first, round(avg(phi), 6) AS second FROM sm JOIN states USING ({K}) GROUP BY ensemble_id, idx, gamma HAVING avg(phi) <= (pi() + 4*(gamma - 1))/(2*gamma*(2 - 1.2))")
def g14(spark, d):
    m = G.state_mean(D.s_global(A.particles(spark, d)), ["S_global"]).join(A.states(spark, d).select(*KEY, "phi", "gamma"), KEY)
    path = m.groupBy("ensemble_id", "idx", "gamma").agg(F.avg("S_global").alias("first"), F.avg("phi").alias("second"))
    return rounded(path.where(F.col("second") <= C.reference_phi("gamma", 1.2)).drop("gamma"), "first", "second")


@query("G16_quality_series", f"WITH {PROPS_SQL} SELECT ensemble_id, replica, CAST(idx AS DOUBLE) AS x, mean_gradient AS y FROM props WHERE mean_gradient <= 0.05")
def g16(spark, d):
    return A.properties(spark, d).where("mean_gradient <= 0.05").select("ensemble_id", "replica", F.col("idx").cast("double").alias("x"), F.col("mean_gradient").alias("y"))


@query("G17_boltzmann", f"""WITH {PROPS_SQL}, m AS (SELECT *, min(energy) OVER (PARTITION BY ensemble_id) AS lo FROM props WHERE replica = 1), b AS (SELECT ensemble_id, sum(exp(-(energy - lo)/0.05)*max_gradient)/sum(exp(-(energy - lo)/0.05)) AS v FROM m GROUP BY 1),
g AS (SELECT ensemble_id, idx, max_gradient, row_number() OVER (PARTITION BY ensemble_id ORDER BY energy, idx DESC) AS k FROM props WHERE replica = 1) SELECT ensemble_id, round(v, 4) AS average, idx AS ground_idx, max_gradient AS ground FROM b JOIN g USING (ensemble_id) WHERE k = 1""")
def g17(spark, d):
    p = A.properties(spark, d).where("replica = 1")
    avg = G.boltzmann_average(p, "energy", ["max_gradient"], 0.05, ["ensemble_id"]).select("ensemble_id", r("max_gradient", 4).alias("average"))
    low = G.ground_state(p, "energy", "idx", ["max_gradient"], ["ensemble_id"])
    return avg.join(low, "ensemble_id").select("ensemble_id", "average", F.col("idx").alias("ground_idx"), F.col("max_gradient").alias("ground"))


@query("R14_ci_band", f"{CI_SQL} SELECT ensemble_id, idx, round(mean - ci, 6) AS low, round(mean + ci, 6) AS high FROM ci")
def r14(spark, d):
    return rounded(G.band(G.replica_mean(A.curves(spark, d), "y", ["ensemble_id", "idx"])), "low", "high").select("ensemble_id", "idx", "low", "high")
