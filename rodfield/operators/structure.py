"""Structure of the neighbour graph: fitted ellipses, smoothed directors, topological defects, rearrangements, slivers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodfield.config import DISK_SPACING, KEY, SIM
from rodfield.functions.columns import axis_angle, r_phi, to_col
from rodfield.operators.delaunay import collapse, edges_of
from rodfield.operators.graph import both_ways, vote
from rodfield.operators.select import value_at_rank
from rodfield.plans.lineage import cut, stored

#: Most edges of a state that one task solves (4 MB of ids); larger graphs are contracted first.
HELD = 1 << 18


def fitted_ellipses(bonds: DataFrame) -> DataFrame:
    """The centred conic p x^2 + q x y + r y^2 = 1 that fits each particle's neighbour offsets best (least squares):
    ``fitted_gamma``, the ratio of its axes (-1 where it is no ellipse), and ``fitted_theta``, the angle of its long axis.
    Fewer than three neighbours determine none."""
    terms = [F.col("dx") * F.col("dx"), F.col("dx") * F.col("dy"), F.col("dy") * F.col("dy")]
    sums = [F.sum(terms[i] * terms[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)] + [F.sum(terms[i]).alias(f"m{i}3") for i in range(3)]
    rows = bonds.groupBy(*KEY, F.col("i").alias("pid")).agg(F.count("*").alias("__n"), *sums)
    # the normal equations are symmetric and positive: elimination keeps the upper half
    for k in (0, 1):
        rows = rows.withColumns({f"m{i}{j}": F.col(f"m{i}{j}") - F.try_divide(F.col(f"m{k}{i}") * F.col(f"m{k}{j}"), F.col(f"m{k}{k}")) for i in range(k + 1, 3) for j in range(i, 4)})
    rows = rows.withColumn("r", F.try_divide("m23", "m22"))
    rows = rows.withColumn("q", F.try_divide(F.col("m13") - F.col("m12") * F.col("r"), F.col("m11")))
    rows = rows.withColumn("p", F.try_divide(F.col("m03") - F.col("m01") * F.col("q") - F.col("m02") * F.col("r"), F.col("m00")))
    # curvatures along the axes: half the trace, more and less the spread
    middle, spread = (F.col("p") + F.col("r")) / 2, F.hypot(F.col("p") - F.col("r"), "q") / 2
    valid = (F.col("__n") >= 3) & F.coalesce(middle - spread > 0, F.lit(False))
    ratio, axis = F.sqrt(F.try_divide(middle + spread, middle - spread)), F.atan2(-F.col("q"), F.col("r") - F.col("p")) / 2
    return rows.select(*KEY, "pid", F.when(valid, ratio).otherwise(-1.0).alias("fitted_gamma"), F.when(valid, axis).otherwise(0.0).alias("fitted_theta"))


def turned_order(bonds: DataFrame, angle: Column, gamma: Column, p: int = 6, extra: tuple[str, ...] = ()) -> DataFrame:
    """|mean exp(i p w)| over neighbours, w the bond angle in the frame turned by ``angle``, stretched across by ``gamma``."""
    along = F.col("dx") * F.cos(angle) + F.col("dy") * F.sin(angle)
    across = gamma * (-F.col("dx") * F.sin(angle) + F.col("dy") * F.cos(angle))
    rows = bonds.withColumn("__w", F.atan2(across, along)).groupBy(*KEY, F.col("i").alias("pid"), *extra)
    return rows.agg(F.hypot(F.avg(F.cos(p * F.col("__w"))), F.avg(F.sin(p * F.col("__w")))).alias("order"))


def fitted_elliptic_phi6(bonds: DataFrame) -> DataFrame:
    """Six-fold order in the fitted ellipse's frame; 0 where its ratio is not in [0, gamma]."""
    fits = fitted_ellipses(bonds)
    rows = bonds.join(fits.withColumnRenamed("pid", "i"), [*KEY, "i"])
    found = turned_order(rows, F.col("fitted_theta"), F.col("fitted_gamma"), 6, ("gamma", "fitted_gamma", "fitted_theta"))
    return found.withColumn("order", F.when((F.col("fitted_gamma") < 0) | (F.col("fitted_gamma") > F.col("gamma")), 0.0).otherwise(F.col("order"))).drop("gamma")


def director(particles: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Axis angle averaged over self and neighbours, ``rounds`` times; 0 rounds: the angle itself."""
    rows = particles.select(*KEY, "pid", axis_angle("t").alias("angle"))
    e2 = both_ways(edges.select(*KEY, "i", "j"))
    e2 = cut(e2) if rounds > 1 else e2
    for done in range(rounds):
        # a round reads its angles twice
        rows = cut(rows) if done else rows
        own = rows.select(*KEY, "pid", "angle")
        near = e2.join(own.withColumnRenamed("pid", "j"), [*KEY, "j"]).select(*KEY, F.col("i").alias("pid"), "angle")
        sums = own.unionByName(near).groupBy(*KEY, "pid").agg(F.sum(F.cos(2 * F.col("angle"))).alias("c"), F.sum(F.sin(2 * F.col("angle"))).alias("s"))
        rows = sums.select(*KEY, "pid", axis_angle(F.atan2(F.col("s"), F.col("c") + F.hypot("c", "s"))).alias("angle"))
    return rows


def rod_triangles(edges: DataFrame) -> DataFrame:
    """Triangles a < b < c of the graph: a's list of larger neighbours goes to each of these, which share c."""
    up = edges.select(*KEY, "i", "j").repartition(*KEY, "i").groupBy(*KEY, "i").agg(F.collect_list("j").alias("up"))
    sent = up.select(*KEY, F.col("i").alias("a"), F.explode("up").alias("b"), F.col("up").alias("sent"))
    met = sent.join(up.withColumnRenamed("i", "b"), [*KEY, "b"])
    return met.select(*KEY, "a", "b", F.explode(F.array_intersect("sent", "up")).alias("c"))


def axis_step(u: Column, v: Column) -> Column:
    """From one axis angle to the next, in units of pi, by the shorter way."""
    step = v - u
    return F.when(step > 0.5, step - 1).when(step < -0.5, step + 1).otherwise(step)


def axis_defects(particles: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles around which the axis turns: ``winding`` 1 or -1 at the centroid (x, y). Triangles with a step of a
    quarter turn are left out."""
    p = particles.select(*KEY, "pid", F.struct(F.col("x"), F.col("y"), (axis_angle("t") / math.pi).alias("u")).alias("q"))
    rows = triangles
    for c in "abc":
        rows = rows.join(p.select(*KEY, F.col("pid").alias(c), F.col("q").alias(f"q{c}")), [*KEY, c])
    mean = lambda n: (F.col(f"qa.{n}") + F.col(f"qb.{n}") + F.col(f"qc.{n}")) / 3
    rows = rows.withColumns({"x": mean("x"), "y": mean("y")})
    corner = lambda c: F.struct(F.atan2(F.col(f"q{c}.y") - F.col("y"), F.col(f"q{c}.x") - F.col("x")).alias("w"), F.col(f"q{c}.u").alias("u"))
    rows = rows.withColumn("__r", F.array_sort(F.array(*map(corner, "abc"))))
    u = [F.col("__r")[n]["u"] for n in (0, 1, 2)]
    steps = [axis_step(u[n], u[(n + 1) % 3]) for n in (0, 1, 2)]
    clear = (F.abs(F.abs(steps[0]) - 0.5) > 1e-4) & (F.abs(F.abs(steps[1]) - 0.5) > 1e-4) & (F.abs(F.abs(steps[2]) - 0.5) > 1e-4)
    return rows.where(clear).withColumn("winding", F.round(steps[0] + steps[1] + steps[2]).cast("int")).where("winding != 0").select(*KEY, "a", "b", "c", "x", "y", "winding")


def segment_rank_mask(orders: DataFrame, edges: DataFrame, states: DataFrame, distance: str = "FarthestSegmentDist", rounds: int = 4) -> DataFrame:
    """``flag`` 1 where the distance is within that at a rank which follows from the packing fraction, after ``rounds``
    majority votes; all 1 from the critical packing fraction on."""
    rows = orders.select(*KEY, "pid", F.col(distance).alias("__l")).join(states.select(*KEY, F.col("n").alias("__n"), r_phi("phi").alias("__r")), KEY)
    rank = F.greatest(F.least(F.bround(F.col("__n") * F.col("__r")), F.col("__n") - 1), F.lit(0))
    rows = rows.withColumn("__k", rank)
    rows = rows.join(value_at_rank(rows, "__l", "__k").withColumnRenamed("at_rank", "__c"), KEY)
    labels = rows.select(*KEY, "pid", (F.col("__l") <= F.col("__c")).cast("int").alias("flag"), (F.col("__r") >= 1).alias("__all"))
    voted = vote(labels, edges, "flag", rounds)
    return voted.select(*KEY, "pid", F.when(F.col("__all"), 1).otherwise(F.col("flag")).alias("flag"))


def misalignment(bonds: DataFrame, z: DataFrame, bins: int = 90) -> DataFrame:
    """Histogram of the angle between the axes of neighbours with five and seven neighbours, folded to [0, pi/2]."""
    one = z.select(*KEY, F.col("pid").alias("i"), F.col("z").alias("zi"))
    two = z.select(*KEY, F.col("pid").alias("j"), F.col("z").alias("zj"))
    rows = bonds.join(one.where("zi = 5"), [*KEY, "i"]).join(two.where("zj = 7"), [*KEY, "j"])
    u = F.abs(F.col("tj") - F.col("ti")) / math.pi
    u = u - F.floor(u)
    bin_ = F.least(F.floor(F.least(u, 1 - u) * 2 * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*KEY, bin_.alias("bin")).agg(F.count("*").alias("count"))


def edge_types(edges: DataFrame, disks, weight: str = "w") -> DataFrame:
    """``type`` of an edge between rods by its contacts: 0 head to head, 1 head to side, 2 side to side."""
    w, m = F.col(weight), to_col(disks)
    return edges.withColumn("type", F.when(w < 0.5 * m, 0).when(w < 1.5 * m, 1).otherwise(2))


def _sides(triangles: DataFrame) -> DataFrame:
    side = lambda p, q: F.struct(F.col(p).alias("i"), F.col(q).alias("j"))
    return triangles.select(*KEY, "a", "b", "c", F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("s")).select(*KEY, "a", "b", "c", "s.i", "s.j")


def without_slivers(points: DataFrame, triangles: DataFrame, least: float = -0.9) -> DataFrame:
    """Triangles of real points, without flat ones (least cosine under ``least``; sides without length count as flat) that
    reach the hull through flat ones. What is left keeps its edges; an edge of removed triangles alone goes."""
    p = points.select(*KEY, "pid", F.struct("x", "y").alias("q"))
    rows = triangles.where("a >= 0")
    for c in "abc":
        rows = rows.join(p.select(*KEY, F.col("pid").alias(c), F.col("q").alias(f"q{c}")), [*KEY, c])

    def cosine(o: str, u: str, v: str) -> Column:
        ux, uy = F.col(f"q{u}.x") - F.col(f"q{o}.x"), F.col(f"q{u}.y") - F.col(f"q{o}.y")
        vx, vy = F.col(f"q{v}.x") - F.col(f"q{o}.x"), F.col(f"q{v}.y") - F.col(f"q{o}.y")
        return F.coalesce(F.try_divide(ux * vx + uy * vy, F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))), F.lit(-1.0))

    rows = cut(rows.select(*KEY, "a", "b", "c", (F.least(cosine("a", "b", "c"), cosine("b", "a", "c"), cosine("c", "a", "b")) < least).alias("flat")))
    sides = _sides(rows)
    flat = cut(sides.join(rows.where("flat").select(*KEY, "a", "b", "c"), [*KEY, "a", "b", "c"], "left_semi"))
    front = cut(sides.groupBy(*KEY, "i", "j").count().where("count = 1").select(*KEY, "i", "j"))
    gone = None
    while True:
        new = flat.join(front, [*KEY, "i", "j"], "left_semi").select(*KEY, "a", "b", "c").distinct()
        new = cut(new.join(gone, [*KEY, "a", "b", "c"], "left_anti") if gone is not None else new)
        if new.isEmpty():
            break
        gone = new if gone is None else cut(gone.unionByName(new))
        front = flat.join(new, [*KEY, "a", "b", "c"], "left_semi").select(*KEY, "i", "j").distinct()
    left = rows.select(*KEY, "a", "b", "c")
    return left.join(gone, [*KEY, "a", "b", "c"], "left_anti") if gone is not None else left


def _least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the entries 0 .. n - 1 reachable from each over edges (a, b): both ends' roots hang on the lesser, and roots are followed to their ends."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
    return root


def _held_roots(found: pa.Table) -> pa.Table:
    """``to``, the least id reachable, of the vertices of a state's edges, HELD at most."""
    ends = np.concatenate([found.column(c).to_numpy() for c in "ij"])
    ids, at = np.unique(ends, return_inverse=True)
    a, b = np.split(at, 2)
    keys = [found.column(c).take(pa.array(np.zeros(len(ids), np.int64))) for c in KEY]
    return pa.table([*keys, pa.array(ids), pa.array(ids[_least_reachable(a, b, len(ids))])], [*KEY, "pid", "to"])


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``label``: the least id reachable in the state. While a state has more than HELD edges, a round makes a smaller graph: a vertex goes to the one
    of least hash among itself and its neighbours, and edges follow. Rounds grow with the logarithm of what HELD is exceeded by and shrink in proportion. What
    is left of a state, HELD edges at most, is solved in one task. The rounds' tables are then followed from the last one back."""
    a, b = F.least("i", "j"), F.greatest("i", "j")
    now, moves = cut(edges.where("i != j").select(*KEY, a.alias("i"), b.alias("j")).distinct()), []
    while not now.groupBy(*KEY).count().where(F.col("count") > HELD).isEmpty():
        rank = lambda c, salt=len(moves): F.xxhash64(F.lit(salt), F.col(c))
        least = both_ways(now).groupBy(*KEY, F.col("i").alias("pid")).agg(F.min_by("j", rank("j")).alias("to"))
        moves.append(cut(least.select(*KEY, "pid", F.when(rank("to") < rank("pid"), F.col("to")).otherwise(F.col("pid")).alias("to"))))
        for c in "ij":
            now = now.join(moves[-1].select(*KEY, F.col("pid").alias(c), F.col("to").alias(f"to_{c}")), [*KEY, c])
        now = cut(now.where("to_i != to_j").select(*KEY, F.least("to_i", "to_j").alias("i"), F.greatest("to_i", "to_j").alias("j")).distinct())
    kinds = {f.name: f.dataType.simpleString() for f in now.schema.fields}
    ends = now.groupBy(*KEY).applyInArrow(_held_roots, ", ".join(f"{c} {kinds[c]}" for c in KEY) + f", pid {kinds['i']}, to {kinds['i']}")
    # one that no later round moves stays; a vertex of a later round is named by an id of its component
    rows = vertices.select(*KEY, "pid")
    if not moves:
        return rows.join(ends, [*KEY, "pid"], "left").select(*KEY, "pid", F.coalesce("to", "pid").alias("label"))
    while moves:
        later = ends.select(*KEY, F.col("pid").alias("to"), F.col("to").alias("end"))
        ends = moves.pop().join(later, [*KEY, "to"], "left").select(*KEY, "pid", F.coalesce("end", "to").alias("to"))
    rows = cut(rows.join(ends, [*KEY, "pid"], "left").select(*KEY, "pid", F.coalesce("to", "pid").alias("end")))
    return rows.join(rows.groupBy(*KEY, "end").agg(F.min("pid").alias("label")), [*KEY, "end"]).select(*KEY, "pid", "label")


def coordination(bodies: DataFrame, degrees: DataFrame) -> DataFrame:
    """Number of neighbours by particle (K, pid, body), 6 near the box, where ``body`` is false. ``degrees``: (K, pid, z) of particles with neighbours."""
    rows = bodies.select(*KEY, "pid", "body").join(degrees.select(*KEY, "pid", "z"), [*KEY, "pid"], "left")
    return rows.select(*KEY, "pid", F.when(~F.col("body"), 6).otherwise(F.coalesce("z", F.lit(0))).alias("z"))


def rearrangements(bodies: DataFrame, edges: DataFrame) -> DataFrame:
    """Events between a state and the one before: ends of new bonds, joined through present bonds among them. By event
    (``label``, its least id): size and the sums of negative and positive charge (z - 6) before and after, particles near the box
    having none. ``bodies``: (K, pid, body), as :func:`coordination` takes them."""
    # a bond's states lie together, so that bonds are dealt once to tell the new ones
    there = F.count("*").over(Window.partitionBy(*SIM, "i", "j").orderBy("idx").rangeBetween(-1, -1))
    now = stored(edges.select(*KEY, "i", "j", (there == 0).alias("new")))
    states = stored(now.select(*KEY).distinct())
    later = stored(states.join(states.withColumn("idx", F.col("idx") + 1), KEY))
    degrees = stored(both_ways(now).groupBy(*KEY, F.col("i").alias("pid")).agg(F.count("*").alias("z"), F.bool_or("new").alias("end")))
    ends = degrees.where("end").select(*KEY, "pid").join(later, KEY, "left_semi")
    among = now.join(ends.withColumnRenamed("pid", "i"), [*KEY, "i"], "left_semi").join(ends.withColumnRenamed("pid", "j"), [*KEY, "j"], "left_semi")
    z = stored(coordination(bodies, degrees))
    before = z.select(*SIM, (F.col("idx") + 1).alias("idx"), "pid", (F.col("z") - 6).alias("q0"))
    rows = components(ends, among).join(z.withColumn("q1", F.col("z") - 6), [*KEY, "pid"]).join(before, [*KEY, "pid"], "left")
    part = lambda q, sign: F.sum(F.when(F.col(q) * sign > 0, F.col(q) * sign).otherwise(0))
    return rows.groupBy(*KEY, "label").agg(F.count("*").alias("size"), part("q0", -1).alias("prev_neg"), part("q0", 1).alias("prev_pos"), part("q1", -1).alias("cur_neg"), part("q1", 1).alias("cur_pos"))


def event_sizes(events: DataFrame, longest: int) -> DataFrame:
    """Counts of events by size bin and step."""
    return events.groupBy(*KEY, F.least(F.floor((F.col("size") + 1) / 2), F.lit(longest - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def gamma_scan(bonds: DataFrame, directors: DataFrame, steps: int = 101, low: float = 1.0, high: float = 2.0) -> DataFrame:
    """Mean elliptic six-fold order per state for trial ratios from ``low`` to ``high``. Sums for all ratios are taken in one pass over a particle's bonds,
    so bonds are not repeated by ratio."""
    rows = bonds.join(directors.select(*KEY, F.col("pid").alias("i"), F.col("angle").alias("__u")), [*KEY, "i"])
    rows = rows.select(*KEY, "i", (F.col("dx") * F.cos("__u") + F.col("dy") * F.sin("__u")).alias("__p"), (-F.col("dx") * F.sin("__u") + F.col("dy") * F.cos("__u")).alias("__q"))
    trials = [low + k * ((high - low) / (steps - 1)) for k in range(steps)]
    turns = [6 * F.atan2(g * F.col("__q"), F.col("__p")) for g in trials]
    sums = rows.groupBy(*KEY, "i").agg(*[F.avg(f(w)).alias(f"__{n}{k}") for k, w in enumerate(turns) for n, f in (("c", F.cos), ("s", F.sin))])
    means = sums.groupBy(*KEY).agg(*[F.avg(F.hypot(f"__c{k}", f"__s{k}")).alias(f"__o{k}") for k in range(steps)])
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("trial"), F.col(f"__o{k}").alias("order")) for k, g in enumerate(trials)]))
    return means.select(*KEY, each.alias("__e")).select(*KEY, "__e.trial", "__e.order")


def best_gamma(scan: DataFrame) -> DataFrame:
    """The trial ratio of highest order by state, the least of equal ones."""
    return scan.groupBy(*KEY).agg(F.max_by("trial", F.struct("order", -F.col("trial"))).alias("trial"), F.max("order").alias("order"))


def best_gamma_cubic(bonds: DataFrame, directors: DataFrame, steps: int = 21) -> DataFrame:
    """The ratio at the maximum of a cubic through the scan by state, and the mean order at that ratio; both null without a fit."""
    from rodfield.operators.series import cubic_fit, cubic_minimum

    scan = gamma_scan(bonds, directors, steps).select(*KEY, F.col("trial").alias("x"), (-F.col("order")).alias("y"))
    best = cubic_minimum(cubic_fit(scan, KEY)).select(*KEY, F.col("x_min").alias("trial"))
    rows = bonds.join(directors.select(*KEY, F.col("pid").alias("i"), F.col("angle").alias("__u")), [*KEY, "i"]).join(best, KEY)
    found = turned_order(rows, F.col("__u"), F.col("trial"), 6, ("trial",)).groupBy(*KEY).agg(F.avg("order").alias("order"))
    return best.join(found, KEY, "left")


def circle_points(states: DataFrame, radius: Column, spacing: float = 0.1) -> DataFrame:
    """Points at equal arcs of about ``spacing`` on a circle around each state: ``g``, ``x``, ``y``. Their number follows from the
    circumference, halves to even; circles too small for one point have none."""
    rows = states.select(*KEY, radius.alias("__r")).withColumn("__n", F.bround(2 * math.pi * F.col("__r") / spacing).cast("int")).where("__n > 0")
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumn("__t", 2 * math.pi * F.col("g") / F.col("__n"))
    return rows.select(*KEY, "g", (F.col("__r") * F.cos("__t")).alias("x"), (F.col("__r") * F.sin("__t")).alias("y"))


#: Nodes and weights of the quadrature of arcs.
_NODES, _WEIGHTS = (x.tolist() for x in np.polynomial.legendre.leggauss(20))


def ellipse_points(states: DataFrame, spacing: float = 0.1, gamma: str = "gamma", steps: int = 12) -> DataFrame:
    """Points at equal arcs on each state's ellipse, its axes longer by 1/gamma: ``g``, ``x``, ``y``. Each point inverts the arc
    length of its own quarter by Newton steps, so that no error adds up along the ellipse."""
    one, two = F.col("a") + 1 / F.col(gamma), F.col("b") + 1 / F.col(gamma)
    rows = states.select(*KEY, (one < two).alias("__turn"), F.greatest(one, two).alias("__a"), F.least(one, two).alias("__b"))
    a, b = F.col("__a"), F.col("__b")

    def speed(t: Column) -> Column:
        return F.hypot(a * F.sin(t), b * F.cos(t))

    def arc(t: Column) -> Column:
        """From the end of the long axis."""
        return t / 2 * sum((w * speed(t / 2 * (1 + x)) for x, w in zip(_NODES, _WEIGHTS, strict=True)), F.lit(0.0))

    rows = rows.withColumn("__quarter", arc(F.lit(math.pi / 2)))
    rows = rows.withColumn("__n", F.bround(4 * F.col("__quarter") / spacing).cast("int")).where("__n > 0")
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumn("__s", 4 * F.col("__quarter") * F.col("g") / F.col("__n"))
    # odd quarters run back from the end of the long axis
    rows = rows.withColumn("__k", F.floor(F.col("__s") / F.col("__quarter")))
    into = F.col("__s") - F.col("__k") * F.col("__quarter")
    rows = rows.withColumn("__goal", F.when(F.col("__k") % 2 == 0, into).otherwise(F.col("__quarter") - into))
    start = math.pi / 2 * F.col("__goal") / F.col("__quarter")
    def newton(state: Column, _: Column) -> Column:
        """A step, unless the last one was too small to count."""
        t = state["t"]
        moved = lambda by: F.struct(F.greatest(F.lit(0.0), F.least(F.lit(math.pi / 2), t - by)).alias("t"), (F.abs(by) > 1e-13).alias("on"))
        return F.when(~state["on"], state).otherwise(F.transform(F.array((arc(t) - F.col("__goal")) / speed(t)), moved)[0])

    rows = rows.withColumn("__t", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(start.alias("t"), F.lit(True).alias("on")), newton)["t"])
    x = a * F.cos("__t") * F.when(F.col("__k").isin(1, 2), -1).otherwise(1)
    y = b * F.sin("__t") * F.when(F.col("__k").isin(2, 3), -1).otherwise(1)
    rows = rows.withColumns({"__x": x, "__y": y})
    return rows.select(*KEY, "g", F.when(F.col("__turn"), -F.col("__y")).otherwise(F.col("__x")).alias("x"), F.when(F.col("__turn"), F.col("__x")).otherwise(F.col("__y")).alias("y"))


#: Ids of disks: the rod's id times this, and the disk's number.
DISKS = 1 << 16


def disks(particles: DataFrame, spacing: float = DISK_SPACING) -> DataFrame:
    """The disks along each rod: ``pid`` of the rod, number ``j``, place (dx, dy). Particles need gamma."""
    rows = particles.withColumn("__m", F.floor(1 + 2 * (F.col("gamma") - 1) / spacing + 1e-9).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    off = (-(F.col("__m") - 1) / 2 + F.col("j")) * spacing / F.col("gamma")
    return rows.select(*KEY, "pid", "j", (F.col("x") + off * F.cos("t")).alias("dx"), (F.col("y") + off * F.sin("t")).alias("dy"))


def disk_points(particles: DataFrame, states: DataFrame, spacing: float = DISK_SPACING) -> DataFrame:
    """Points (K, pid, x, y) of all disks, and of the ellipse around each state with negative ids."""
    real = disks(particles, spacing).select(*KEY, (F.col("pid") * DISKS + F.col("j")).alias("pid"), F.col("dx").alias("x"), F.col("dy").alias("y"))
    return real.unionByName(ellipse_points(states, spacing).select(*KEY, (-1 - F.col("g")).cast("long").alias("pid"), "x", "y"))


def rod_edges(triangles: DataFrame) -> DataFrame:
    """Edges between rods from triangles of their disks, weighted by contacts ``w``."""
    return collapse(edges_of(triangles), lambda disk: F.floor(disk / DISKS).cast("long"))
