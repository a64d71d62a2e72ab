"""Queries on series and curves, each with equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from rodfield.config import KEY, SIM
from rodfield.operators import pairs as P
from rodfield.operators import select as B
from rodfield.operators import series as S
from rodfield.plans.base_queries import BASE, CURVES_SQL, K, particles_sql, r, rounded
from rodfield.sources import adapters as A

QUERIES, ORACLES = {}, {}
C = f"WITH {CURVES_SQL}"
SW = "WINDOW w AS (PARTITION BY ensemble_id, replica ORDER BY idx)"
SJ = "USING (ensemble_id, replica)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("R1_relative_curves", f"{C} SELECT {K}, round(y/nullif(first_value(y) OVER w, 0), 6) AS relative FROM curves {SW}")
def r1(spark, d):
    return rounded(S.relative_to_first(A.curves(spark, d)), "relative").select(*KEY, "relative")


@query("R2_downsample", f"""{C}, p AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY ensemble_id, replica) AS n FROM curves {SW}),
s AS (SELECT *, CASE WHEN n >= 40 THEN n // 20 ELSE 1 END AS s FROM p), t AS (SELECT ensemble_id, replica, p//s - greatest(CAST(ceil(n/s) AS BIGINT) - 20, 0) AS k, y FROM s WHERE p % s = 0),
g AS (SELECT DISTINCT ensemble_id, replica, CAST(k AS INTEGER) AS k FROM curves, range(20) r(k)) SELECT ensemble_id, replica, k, round(y, 6) AS value FROM g LEFT JOIN t USING (ensemble_id, replica, k)""")
def r2(spark, d):
    return rounded(S.downsample(A.curves(spark, d), 20), "value")


@query("R3_plateau", f"""{C}, h AS (SELECT *, CAST(coalesce(y < 20 OR 1 - y/nullif(lag(y, 4) OVER w, 0) < 0.05, false) AS INTEGER) AS h FROM curves {SW}),
f AS (SELECT *, sum(h) OVER (PARTITION BY ensemble_id, replica ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r FROM h) SELECT ensemble_id, replica, min(CASE WHEN r = 5 THEN idx END) AS at FROM f GROUP BY 1, 2""")
def r3(spark, d):
    return S.plateau(A.curves(spark, d), least=20.0, slope=0.01, stride=5, occurrence=5)


#: Splines by first derivatives k at the points, from the recursion down the rows and up again; h, s: width and slope of the piece that follows.
SPLINE_SQL = f"""pt AS MATERIALIZED (SELECT ensemble_id, replica, row_number() OVER v - 1 AS p, x, y, count(*) OVER (PARTITION BY ensemble_id, replica) AS n, lead(x) OVER v AS x1, lead(y) OVER v AS y1,
  lead(x) OVER v - x AS h, (lead(y) OVER v - y)/(lead(x) OVER v - x) AS s FROM curves WHERE x IS NOT NULL AND y IS NOT NULL WINDOW v AS (PARTITION BY ensemble_id, replica ORDER BY x)),
nb AS (SELECT *, lag(h) OVER v AS hb, lag(s) OVER v AS sb, lag(h, 2) OVER v AS hbb, lag(s, 2) OVER v AS sbb, lead(h) OVER v AS ha, lead(s) OVER v AS sa FROM pt WINDOW v AS (PARTITION BY ensemble_id, replica ORDER BY p)),
eq AS MATERIALIZED (SELECT ensemble_id, replica, p, n, CASE WHEN p = 0 THEN 0 WHEN p = n - 1 THEN hb + hbb ELSE h END AS lo, CASE WHEN p = 0 THEN ha WHEN p = n - 1 THEN hbb ELSE 2*(hb + h) END AS mi,
  CASE WHEN p = 0 THEN h + ha WHEN p = n - 1 THEN 0 ELSE hb END AS up, CASE WHEN p = 0 THEN ((3*h + 2*ha)*ha*s + h*h*sa)/(h + ha) WHEN p = n - 1 THEN (hb*hb*sbb + (2*hbb + 3*hb)*hbb*sb)/(hb + hbb) ELSE 3*(h*sb + hb*s) END AS rh FROM nb WHERE n >= 4),
dn AS (SELECT ensemble_id, replica, p, n, up/mi AS c, rh/mi AS d FROM eq WHERE p = 0
  UNION ALL SELECT e.ensemble_id, e.replica, e.p, e.n, e.up/(e.mi - e.lo*f.c), (e.rh - e.lo*f.d)/(e.mi - e.lo*f.c) FROM dn f JOIN eq e ON e.ensemble_id = f.ensemble_id AND e.replica = f.replica AND e.p = f.p + 1),
ks AS (SELECT ensemble_id, replica, p, d AS k FROM dn WHERE p = n - 1
  UNION ALL SELECT e.ensemble_id, e.replica, e.p, e.d - e.c*f.k FROM ks f JOIN dn e ON e.ensemble_id = f.ensemble_id AND e.replica = f.replica AND e.p = f.p - 1),
few AS (SELECT ensemble_id, replica, p, CASE WHEN n = 2 THEN coalesce(s, sb) WHEN p = 0 THEN s - h*(sa - s)/(h + ha) WHEN p = 1 THEN sb + hb*(s - sb)/(hb + h) ELSE sb + hb*(sb - sbb)/(hb + hbb) END AS k FROM nb WHERE n < 4),
sl AS MATERIALIZED (SELECT * FROM ks UNION ALL SELECT * FROM few),
pc AS (SELECT a.*, b.k, lead(b.k) OVER (PARTITION BY a.ensemble_id, a.replica ORDER BY a.p) AS k1 FROM pt a JOIN sl b USING (ensemble_id, replica, p)),
sp AS (SELECT ensemble_id, min(x) AS low, max(x) AS high, greatest(2, CAST(ceil((max(x) - min(x))/2.5) AS INTEGER)) AS m FROM pt GROUP BY 1),
gr AS (SELECT ensemble_id, replica, CAST(j AS INTEGER) AS j, CASE WHEN j = m - 1 THEN high ELSE low + j*((high - low)/(m - 1)) END AS g FROM (SELECT DISTINCT ensemble_id, replica FROM pt) JOIN sp USING (ensemble_id), LATERAL (SELECT unnest(range(m)) AS j)),
on_ AS (SELECT q.ensemble_id, q.replica, q.j, CASE WHEN a.h IS NULL THEN a.y ELSE (1 + 2*(g - a.x)/a.h)*((a.x1 - g)/a.h)**2*a.y + (g - a.x)*((a.x1 - g)/a.h)**2*a.k + ((g - a.x)/a.h)**2*(1 + 2*(a.x1 - g)/a.h)*a.y1 + ((g - a.x)/a.h)**2*(g - a.x1)*a.k1 END AS y
  FROM gr q JOIN pc a ON a.ensemble_id = q.ensemble_id AND a.replica = q.replica AND q.g >= a.x AND (q.g < a.x1 OR a.x1 IS NULL AND q.g = a.x))"""


@query("R4_spline_grid", f"{C.replace('WITH ', 'WITH RECURSIVE ', 1)}, {SPLINE_SQL} SELECT ensemble_id, replica, j, round(g, 6) AS x, round(y, 6) AS y FROM gr LEFT JOIN on_ USING (ensemble_id, replica, j)")
def r4(spark, d):
    return rounded(S.spline_resample(A.curves(spark, d), 2.5), "x", "y")


@query("R5_first_bad", f"""{C}, g AS (SELECT DISTINCT ensemble_id, replica, CAST(i AS INTEGER) AS idx FROM curves, range(120) r(i)) SELECT ensemble_id, replica, min(CASE WHEN y IS NULL THEN idx END) AS first_bad FROM g LEFT JOIN curves USING ({K}) GROUP BY 1, 2""")
def r5(spark, d):
    c = A.curves(spark, d)
    grid = c.select(*SIM).distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(119))))
    return B.first_bad(grid.join(c, KEY, "left"), "y")


FITS_SQL = """fits AS (SELECT * FROM (SELECT ensemble_id, replica, idx, row_number() OVER b AS k, count(*) OVER (PARTITION BY ensemble_id, replica) AS n, regr_slope(y, x) OVER b AS slope, regr_intercept(y, x) OVER b AS intercept, regr_r2(y, x) OVER b AS r2
  FROM curves WINDOW b AS (PARTITION BY ensemble_id, replica ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE k >= 2 AND k < n)"""
LOG_SQL = """num AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id, replica ORDER BY idx DESC) - 1 AS k FROM {0}),
logfits AS (SELECT b.ensemble_id, b.replica, b.k, b.idx AS base, regr_slope(ln(c.y), ln(c.x - b.x)) AS slope, regr_intercept(ln(c.y), ln(c.x - b.x)) AS intercept, regr_r2(ln(c.y), ln(c.x - b.x)) AS r2
  FROM num b JOIN {0} c ON b.ensemble_id = c.ensemble_id AND b.replica = c.replica AND c.idx > b.idx AND c.x > b.x AND c.y > 0 WHERE b.k >= 2 GROUP BY ALL)"""
CRITICAL_SQL = f"""{FITS_SQL}, xs AS (SELECT f.*, -intercept/nullif(slope, 0) AS xc FROM fits f WHERE r2 < 0.9999),
tops AS (SELECT ensemble_id, replica, max(x) AS top FROM curves GROUP BY 1, 2), firsts AS (SELECT ensemble_id, replica, min(k) AS k, min_by(xc, k) AS xc FROM xs JOIN tops {SJ} WHERE xc < top GROUP BY 1, 2),
critical AS (SELECT ensemble_id, replica, min(k) AS k, min(xc) AS xc, min(idx) AS pos FROM curves JOIN firsts {SJ} WHERE x > xc GROUP BY 1, 2)"""


@query("R6_suffix_regression", f"{C}, {FITS_SQL} SELECT {K}, k, round(slope, 4) + 0.0 AS slope, round(intercept, 2) + 0.0 AS intercept, round(r2, 4) + 0.0 AS r2 FROM fits")
def r6(spark, d):
    rows = S.suffix_regression(A.curves(spark, d))
    return rows.select(*KEY, "k", r("slope", 4).alias("slope"), r("intercept", 2).alias("intercept"), r("r2", 4).alias("r2"))


@query("R6_log_suffix_regression", f"{C}, {LOG_SQL.format('curves')} SELECT ensemble_id, replica, k, base, round(slope, 4) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(r2, 4) + 0.0 AS r2 FROM logfits")
def r6_log(spark, d):
    return rounded(S.log_suffix_regression(A.curves(spark, d)), "slope", "intercept", "r2", digits=4)


@query("R7_critical_point", f"{C}, {CRITICAL_SQL} SELECT ensemble_id, replica, k, round(xc, 3) AS xc, pos FROM critical")
def r7(spark, d):
    return rounded(S.critical_point(A.curves(spark, d)), "xc", digits=3).withColumnRenamed("at", "pos")


def savgol_sql(source: str, value: str, at: str, window: int, order: int, name: str) -> str:
    rows = ", ".join(f"({e}, {j}, {w!r})" for e, line in enumerate(S.savgol_table(window, order)) for j, w in enumerate(line))
    return f"""{name}_t(e, j, w) AS (VALUES {rows}), {name}_p AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id, replica ORDER BY {at}) - 1 AS p, count(*) OVER (PARTITION BY ensemble_id, replica) AS n FROM {source}),
{name}_s AS (SELECT *, greatest(least(p - {window // 2}, n - {window}), 0) AS s FROM {name}_p),
{name} AS (SELECT a.ensemble_id, a.replica, a.{at}, sum(t.w*b.{value}) AS smooth FROM {name}_s a JOIN {name}_t t ON t.e = a.p - a.s JOIN {name}_p b ON a.ensemble_id = b.ensemble_id AND a.replica = b.replica AND b.p = a.s + t.j WHERE a.n >= {window} GROUP BY ALL)"""


def peak_sql(source: str, value: str, at: str, name: str) -> str:
    """Peaks without flat tops."""
    return f"""{name}_n AS (SELECT ensemble_id, replica, {at} AS pos, {value} AS v, lag({value}) OVER w AS l, lead({value}) OVER w AS r FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY ensemble_id, replica ORDER BY {at})),
{name}_b AS (SELECT p.ensemble_id, p.replica, p.pos, p.v, max(CASE WHEN q.v > p.v AND q.pos < p.pos THEN q.pos END) AS lo, min(CASE WHEN q.v > p.v AND q.pos > p.pos THEN q.pos END) AS hi FROM {name}_n p JOIN {name}_n q {SJ} WHERE p.l < p.v AND p.r < p.v GROUP BY p.ensemble_id, p.replica, p.pos, p.v),
{name}_d AS (SELECT p.ensemble_id, p.replica, p.pos, p.v, p.v - greatest(min(CASE WHEN q.pos < p.pos THEN q.v END), min(CASE WHEN q.pos > p.pos THEN q.v END)) AS prominence FROM {name}_b p JOIN {name}_n q {SJ} WHERE (lo IS NULL OR q.pos > lo) AND (hi IS NULL OR q.pos < hi) GROUP BY p.ensemble_id, p.replica, p.pos, p.v),
{name} AS (SELECT ensemble_id, replica, pos AS peak, v AS height, prominence FROM (SELECT *, row_number() OVER (PARTITION BY ensemble_id, replica ORDER BY prominence DESC, pos) AS o FROM {name}_d) WHERE o = 1)"""


@query("R8_savgol", f"{C}, {savgol_sql('curves', 'y', 'idx', 21, 3, 'sg')} SELECT {K}, round(smooth, 6) + 0.0 AS smooth FROM sg")
def r8(spark, d):
    return rounded(S.savgol(A.curves(spark, d), 21, 3), "smooth").select(*KEY, "smooth").where("smooth is not null")


@query("R9_prominent_peak", f"{C}, {peak_sql('curves', 'y', 'idx', 'pk')} SELECT ensemble_id, replica, peak, round(height, 6) AS height, round(prominence, 6) AS prominence FROM pk")
def r9(spark, d):
    return rounded(S.prominent_peak(A.curves(spark, d)), "height", "prominence")


POWER_SQL = f"""{CRITICAL_SQL}, cutoff AS (SELECT c.* FROM curves c LEFT JOIN (SELECT ensemble_id, replica, pos FROM critical) z {SJ} WHERE pos IS NULL OR idx < pos), {LOG_SQL.format('cutoff')}, lf AS (SELECT * FROM logfits WHERE r2 IS NOT NULL),
{savgol_sql('lf', 'r2', 'k', 9, 2, 'sm')}, {peak_sql('sm', 'smooth', 'k', 'pk')}, power AS (SELECT f.ensemble_id, f.replica, k, base AS turning, slope AS exponent, exp(intercept) AS factor, r2 FROM lf f JOIN pk ON f.ensemble_id = pk.ensemble_id AND f.replica = pk.replica AND f.k = pk.peak)"""


@query("R10_power_fit", f"{C}, {POWER_SQL} SELECT ensemble_id, replica, k, turning, round(exponent, 4) + 0.0 AS exponent, round(factor, 3) AS factor, round(r2, 4) AS r2 FROM power")
def r10(spark, d):
    return S.power_fit(A.curves(spark, d)).select(*SIM, "k", "turning", r("exponent", 4).alias("exponent"), r("factor", 3).alias("factor"), r("r2", 4).alias("r2"))


@query("R10_truncate_at_turning", f"{C}, {POWER_SQL} SELECT {K}, round(y, 6) AS y FROM curves JOIN (SELECT ensemble_id, replica, turning FROM power) {SJ} WHERE idx <= turning")
def r10_truncate(spark, d):
    c = A.curves(spark, d)
    return rounded(S.truncate_at(c, S.power_fit(c)), "y").select(*KEY, "y")


def _det(rows: list[list[str]]) -> str:
    if len(rows) == 1:
        return rows[0][0]
    return "(" + " + ".join(f"({'-' if j % 2 else ''}1)*{v}*{_det([[*x[:j], *x[j + 1:]] for x in rows[1:]])}" for j, v in enumerate(rows[0])) + ")"


def _cubic_sql() -> str:
    m = [[f"m{i + j}" for j in range(4)] for i in range(4)]
    det = {n: _det([[f"v{i}" if j == n else m[i][j] for j in range(4)] for i in range(4)]) for n in range(4)}
    sums = ", ".join([f"sum(pow(u, {n})) AS m{n}" for n in range(7)] + [f"sum(pow(u, {n})*y) AS v{n}" for n in range(4)])
    return f"""cs AS (SELECT *, x/max(abs(x)) OVER (PARTITION BY ensemble_id, replica) AS u, max(abs(x)) OVER (PARTITION BY ensemble_id, replica) AS s FROM curves),
cm AS (SELECT ensemble_id, replica, {sums}, min(s) AS s, min(x) AS low, max(x) AS high, count(DISTINCT x) AS points FROM cs GROUP BY 1, 2), cd AS (SELECT *, {_det(m)} AS dd FROM cm WHERE points >= 4),
cq AS (SELECT ensemble_id, replica, s, low, high, {', '.join(f'{det[n]}/dd AS q{n}' for n in range(4))} FROM cd),
cerr AS (SELECT ensemble_id, replica, avg((y - q0 - q1*u - q2*u*u - q3*u*u*u)*(y - q0 - q1*u - q2*u*u - q3*u*u*u)) AS mse FROM cs JOIN (SELECT ensemble_id, replica, q0, q1, q2, q3 FROM cq) {SJ} GROUP BY 1, 2),
cf AS (SELECT ensemble_id, replica, q3/(s*s*s) AS a, q2/(s*s) AS b, q1/s AS c, q0 AS d, mse, low, high FROM cq JOIN cerr {SJ}),
ci AS (SELECT *, CASE WHEN abs(a) > 1e-6 THEN CASE WHEN b*b - 3*a*c > 1e-6 AND 2*sqrt(greatest(b*b - 3*a*c, 0)) > 1e-6 THEN (-b + sqrt(greatest(b*b - 3*a*c, 0)))/(3*a) END WHEN b > 1e-6 THEN -c/(2*b) END AS inn,
  ((a*low + b)*low + c)*low + d AS f0, ((a*high + b)*high + c)*high + d AS f1 FROM cf)"""


@query("R11_cubic_minimum", f"{C}, {_cubic_sql()} SELECT ensemble_id, replica, round(d, 3) AS d, round(c, 4) + 0.0 AS c, round(b, 5) + 0.0 AS b, round(mse, 3) AS mse, round(CASE WHEN inn BETWEEN low AND high THEN inn WHEN f0 < f1 THEN low ELSE high END, 2) AS x_min FROM ci")
def r11(spark, d):
    rows = S.cubic_minimum(S.cubic_fit(A.curves(spark, d))).where("a is not null")
    return rows.select(*SIM, r("d", 3).alias("d"), r("c", 4).alias("c"), r("b", 5).alias("b"), r("mse", 3).alias("mse"), r("x_min", 2).alias("x_min"))


@query("R13_curve_direction", f"""{C}, {savgol_sql('curves', 'y', 'idx', 9, 2, 'sg')}, n AS (SELECT {K}, (x - min(x) OVER v)/(max(x) OVER v - min(x) OVER v) AS x, smooth AS y FROM curves JOIN sg USING ({K}) WINDOW v AS (PARTITION BY ensemble_id, replica)),
l AS (SELECT *, x - lag(x) OVER w AS hb, lead(x) OVER w - x AS hf, y - lag(y) OVER w AS db, lead(y) OVER w - y AS df FROM n {SW}), s AS (SELECT {K}, x, y, coalesce((db/hb*hf + df/hf*hb)/(hb + hf), db/hb, df/hf) AS slope FROM l),
b AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(slope) OVER w AS s2 FROM s {SW}) SELECT ensemble_id, replica, q::DOUBLE AS place, round(y + (q - x)/(x2 - x)*(y2 - y), 6) AS y, round(slope + (q - x)/(x2 - x)*(s2 - slope), 4) + 0.0 AS slope FROM b, (SELECT unnest([0.25, 0.5, 0.75]) AS q) WHERE x <= q AND q < x2""")
def r13(spark, d):
    smooth = S.savgol(A.curves(spark, d), 9, 2).where("smooth is not null")
    rows = smooth.select(*KEY, S.normalize01("x").alias("x"), F.col("smooth").alias("y")).where("x is not null")
    found = S.at_places(S.uneven_derivative(rows), [0.25, 0.5, 0.75], values=("y", "slope"))
    return found.select(*SIM, "place", r("y").alias("y"), r("slope", 4).alias("slope"))


def _smooth_sql(bins: int, sigma: float) -> str:
    reach = int(4 * sigma + 0.5)
    total = f"(SELECT sum(exp(-0.5*(k/{sigma})*(k/{sigma}))) FROM range(-{reach}, {reach} + 1) z(k))"
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY {{by}} ORDER BY bin) - 1 AS i, count(*) OVER (PARTITION BY {{by}}) AS n FROM {{source}}),
at_ AS (SELECT {{by}}, bin, x, n, exp(-0.5*(k/{sigma})*(k/{sigma}))/{total} AS w, ((i + k) % (2*n) + 2*n) % (2*n) AS pos FROM i, range(-{reach}, {reach} + 1) r(k)),
sm AS (SELECT {{a}}, a.bin, sum(w*i.y) AS y FROM at_ a JOIN i ON {{on}} AND i.i = CASE WHEN pos < a.n THEN pos ELSE 2*a.n - 1 - pos END GROUP BY ALL)"""


BY3 = {"by": K, "a": "a.ensemble_id, a.replica, a.idx", "on": "a.ensemble_id = i.ensemble_id AND a.replica = i.replica AND a.idx = i.idx"}
BIN_SQL = f"m AS (SELECT {K}, min(r) AS lo, max(r) AS hi FROM c GROUP BY ALL), bb AS (SELECT c.*, lo, hi, CAST(floor((r - 1e-6 - lo)/((hi - lo)/{{bins}})) AS INTEGER) AS bin FROM c JOIN m USING ({K})), bn AS (SELECT {K}, bin, min(lo) + (bin + 0.5)*(min(hi - lo)/{{bins}}) + 1e-6 AS x, avg(c) AS y FROM bb WHERE bin BETWEEN 0 AND {{bins}} - 1 GROUP BY {K}, bin)"
PQ = "FROM f p JOIN f q ON p.ensemble_id = q.ensemble_id AND p.replica = q.replica AND p.idx = q.idx AND p.pid <= q.pid"
RPQ = "sqrt((p.x - q.x)*(p.x - q.x) + (p.y - q.y)*(p.y - q.y))"


@query("P6_smoothed_correlation", f"WITH {particles_sql()}, f AS (SELECT * FROM particles), c AS (SELECT p.ensemble_id, p.replica, p.idx, {RPQ} AS r, cos(2*(p.t - q.t)) AS c {PQ}), {BIN_SQL.format(bins=50)}, {_smooth_sql(50, 2.0).format(source='bn', **BY3)} SELECT {K}, bin, round(y, 6) + 0.0 AS y FROM sm")
def p6(spark, d):
    binned = P.pair_bins(A.particles(spark, d), ["x", "y", "t"], P.aligned, 50)
    return rounded(P.gaussian_smooth(binned, "y", 2.0, KEY), "y").select(*KEY, "bin", "y")


@query("P7_correlation_study", f"""{BASE}, w AS (SELECT *, min(CASE WHEN phi > 0.36 THEN idx END) OVER (PARTITION BY ensemble_id, replica) AS hi FROM states), s AS (SELECT {K} FROM w WHERE idx % 20 = 0 AND (hi IS NULL OR idx < hi)),
f0 AS (SELECT p.*, cos(2*t) + 2 AS u FROM particles p JOIN s USING ({K})), f AS (SELECT *, avg(u) OVER (PARTITION BY ensemble_id, idx) AS mu FROM f0),
c AS (SELECT p.ensemble_id, p.replica, p.idx, {RPQ} AS r, (p.u - p.mu)*(q.u - q.mu)/(p.mu*p.mu) AS c {PQ}), {BIN_SQL.format(bins=1000)}, {_smooth_sql(1000, 5.0).format(source='bn', **BY3)} SELECT {K}, bin, round(y, 6) + 0.0 AS y FROM sm""")
def p7(spark, d):
    chosen = B.index_interval(A.states(spark, d), upper_phi=0.36).where("idx % 20 = 0").select(*KEY)
    f = A.particles(spark, d).where("idx % 20 = 0").join(chosen, KEY, "left_semi").withColumn("u", F.cos(2 * F.col("t")) + 2)
    binned = P.pair_bins(P.deviations(f, "u", "u", ["ensemble_id", "idx"]), ["x", "y", "a", "b", "k"], P.product, 1000)
    return rounded(P.gaussian_smooth(binned, "y", 5.0, KEY), "y").select(*KEY, "bin", "y")
