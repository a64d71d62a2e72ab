"""Order parameters over the neighbour graph: all from grouped sums over directed edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rodfield.config import KEY, SEGDIST_DENSE, SEGDIST_SPARSE
from rodfield.functions.columns import axis_angle, segment_distance
from rodfield.plans.lineage import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    rest = [c for c in edges.columns if c not in (*KEY, "i", "j")]
    return edges.unionByName(edges.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def neighbours(edges: DataFrame) -> DataFrame:
    """Per particle the ids of its neighbours, ``near``. Edges are dealt before they are gathered, as lists of one id would be wider than the id."""
    return both_ways(edges.select(*KEY, "i", "j")).repartition(*KEY, "j").groupBy(*KEY, F.col("j").alias("pid")).agg(F.collect_list("i").alias("near"))


def directed_bonds(particles: DataFrame, edges: DataFrame, lists: bool = False) -> DataFrame:
    """Directed edges with offset, bond angle, both axis angles and the distance of the rods, and if ``lists`` the ids of j's neighbours, ``near``.
    Particles need gamma. The end j is met first, so that rows lie by i for whatever groups them."""
    p = particles.select(*KEY, "pid", "x", "y", "t", "gamma")
    a = p.select(*KEY, F.col("pid").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("t").alias("ti"), "gamma")
    b = p.select(*KEY, F.col("pid").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("t").alias("tj"))
    if lists:
        ends = neighbours(edges).withColumnRenamed("pid", "j").join(b, [*KEY, "j"]).withColumn("i", F.explode("near"))
    else:
        ends = both_ways(edges.select(*KEY, "i", "j")).join(b, [*KEY, "j"])
    rows = ends.join(a, [*KEY, "i"]).withColumns({"dx": F.col("xj") - F.col("xi"), "dy": F.col("yj") - F.col("yi")})
    far = segment_distance(1 - 1 / F.col("gamma"), "xi", "yi", "ti", "xj", "yj", "tj")
    return rows.withColumns({"bond": F.atan2("dy", "dx"), "far": far}).select(*KEY, "i", "j", "dx", "dy", "bond", "ti", "tj", "gamma", "far", *["near"] * lists)


def graph_boundary(edges: DataFrame) -> DataFrame:
    """Ends of edges whose two ends share exactly one neighbour: a particle's list goes to its neighbours of larger id."""
    near = neighbours(edges)
    sent = near.select(*KEY, F.explode("near").alias("pid"), F.col("pid").alias("i"), F.col("near").alias("sent")).where("i < pid")
    met = sent.join(near, [*KEY, "pid"]).where(F.size(F.array_intersect("sent", "near")) == 1)
    return met.select(*KEY, F.explode(F.array("i", "pid")).alias("pid")).distinct()


def complex_column(re, im):
    return F.struct(re.alias("re"), im.alias("im"))


def bond_order(bonds: DataFrame, p: int) -> DataFrame:
    """``phi``: the mean of exp(i p angle) over each particle's bonds, for an even p."""
    if p % 2:
        raise ValueError("the fold is even, so that a bond counts alike from both ends")
    w = p * F.col("bond")
    return bonds.groupBy(*KEY, F.col("i").alias("pid")).agg(complex_column(F.avg(F.cos(w)), F.avg(F.sin(w))).alias("phi"))


def _director(t, c, s) -> tuple:
    """The director's angle of a particle and its neighbours, from the sums of the latter's doubled cosines and sines, and the length of the whole sum."""
    c, s = c + F.cos(2 * t), s + F.sin(2 * t)
    length = F.sqrt(c * c + s * s)
    return axis_angle(F.atan2(s, c + length)), length


def order_parameters(particles: DataFrame, edges: DataFrame, boundary: bool = True) -> DataFrame:
    """All order parameters of the graph, one row per particle; null without neighbours. Without ``boundary``, that and C6 are left out, and no lists of neighbours are dealt."""
    bonds = directed_bonds(particles, edges, lists=boundary)
    # a bond sees the sums over its particle's bonds, which lie together, so that bonds are made and dealt once, and none are held in lists
    around = Window.partitionBy(*KEY, "i")
    bonds = bonds.withColumns({"__c2": F.sum(F.cos(2 * F.col("tj"))).over(around), "__s2": F.sum(F.sin(2 * F.col("tj"))).over(around), **({"__ids": F.collect_list("j").over(around)} if boundary else {})})
    angle, _ = _director(F.col("ti"), F.col("__c2"), F.col("__s2"))
    bonds = bonds.withColumn("__d", angle).withColumns({"__u": F.cos("__d"), "__v": F.sin("__d")})
    turned = F.atan2(F.col("gamma") * (F.col("dy") * F.col("__u") - F.col("dx") * F.col("__v")), F.col("dx") * F.col("__u") + F.col("dy") * F.col("__v"))
    bonds = bonds.withColumn("__w", 6 * turned)
    total = lambda c, name: F.sum(c).alias(name)
    edge = [F.bool_or(F.size(F.array_intersect("near", "__ids")) == 1).alias("on_boundary")] if boundary else []
    sums = bonds.groupBy(*KEY, F.col("i").alias("pid")).agg(
        F.count("*").alias("z"), *[total(f(p * F.col("bond")), f"{n}_{p}") for p in (4, 6) for n, f in (("c", F.cos), ("s", F.sin))],
        total(F.cos(2 * (F.col("tj") - F.col("ti"))), "cc"), F.first("__c2").alias("c2"), F.first("__s2").alias("s2"), total(F.cos("__w"), "cw"), total(F.sin("__w"), "sw"),
        total(F.col("dx") * F.col("dy"), "xy"), total(F.col("dx") * F.col("dx") - F.col("dy") * F.col("dy"), "xx_yy"), F.max("far").alias("farthest"), F.avg("far").alias("mean_far"), *edge,
    )
    rows = particles.join(sums, [*KEY, "pid"], "left")
    z = F.coalesce("z", F.lit(0))
    angle, length = _director(F.col("t"), F.coalesce("c2", F.lit(0.0)), F.coalesce("s2", F.lit(0.0)))
    rows = rows.withColumns({"z": z, **({"on_boundary": F.coalesce("on_boundary", F.lit(False))} if boundary else {})})
    rows = rows.withColumns({
        **{f"Phi{p}Complex": F.when(F.col("z") > 0, complex_column(F.col(f"c_{p}") / F.col("z"), F.col(f"s_{p}") / F.col("z"))) for p in (4, 6)},
        "Phi4": F.hypot("c_4", "s_4") / F.when(F.col("z") > 0, F.col("z")), "Phi6": F.hypot("c_6", "s_6") / F.when(F.col("z") > 0, F.col("z")), "S_center": F.col("cc") / F.when(F.col("z") > 0, F.col("z")),
        "S_local": length / (F.col("z") + 1), "DirectorAngle": angle, "PureRotationAngle": axis_angle(0.5 * F.atan2(2 * F.col("xy"), F.col("xx_yy"))),
        "FarthestSegmentDist": F.coalesce("farthest", F.lit(0.0)) * F.col("gamma"), "MeanSegmentDist": F.col("mean_far") * F.col("gamma"), "C6_raw": (F.col("z") == 6).cast("double"),
    })
    c6 = {"C6": F.when(~F.col("on_boundary"), F.col("C6_raw"))} if boundary else {}
    rows = rows.withColumns({**c6, "CrystalNematicAngle": F.cos(2 * (F.col("DirectorAngle") - F.col("PureRotationAngle")))})
    f = F.col("FarthestSegmentDist")
    rows = rows.withColumn("raw_dense", F.when(f < SEGDIST_DENSE, 2).when(f <= SEGDIST_SPARSE, 1).otherwise(0))
    rows = rows.withColumn("EllipticPhi6", F.hypot("cw", "sw") / F.when(F.col("z") > 0, F.col("z")))
    return rows.drop("c_4", "s_4", "c_6", "s_6", "cc", "c2", "s2", "cw", "sw", "xy", "xx_yy", "farthest", "mean_far")


def vote(labels: DataFrame, edges: DataFrame, label: str, rounds: int = 1) -> DataFrame:
    """Majority of the neighbours' labels; the smaller of equally frequent ones, -1 without neighbours."""
    near = cut(neighbours(edges)) if rounds > 1 else neighbours(edges)
    for done in range(rounds):
        # a round reads its labels twice
        labels = cut(labels) if done else labels
        # votes are dealt once, for both groupings
        seen = near.join(labels.select(*KEY, "pid", F.col(label).alias("l")), [*KEY, "pid"]).select(*KEY, F.explode("near").alias("pid"), "l").repartition(*KEY, "pid")
        won = seen.groupBy(*KEY, "pid", "l").agg(F.count("*").alias("n")).groupBy(*KEY, "pid").agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("__l"))
        labels = labels.join(won, [*KEY, "pid"], "left").withColumn(label, F.coalesce("__l", F.lit(-1))).drop("__l")
    return labels


def isolated_defects(z: DataFrame, edges: DataFrame) -> DataFrame:
    """Particles (K, pid, z, body) with ``isolated``: a defect (z != 6) in the body without a neighbour that is a defect with
    another z; ``isolatedDefect`` and ``isolatedDefectRatio``: that flag times the state's number of particles over its number in
    the body, and over its number of defects in the body."""
    defects = z.where("z != 6").select(*KEY, "pid", "z")
    e2 = both_ways(edges.select(*KEY, "i", "j"))
    other = e2.join(defects.select(*KEY, F.col("pid").alias("j"), F.col("z").alias("zj")), [*KEY, "j"]).withColumnRenamed("i", "pid")
    bad = defects.join(other, [*KEY, "pid"]).where("z != zj").select(*KEY, "pid").distinct().withColumn("__bad", F.lit(True))
    counts = z.groupBy(*KEY).agg(F.count("*").alias("__n"), F.count_if("body").alias("__body"), F.count_if(F.col("body") & (F.col("z") != 6)).alias("__defects"))
    rows = z.join(bad, [*KEY, "pid"], "left").join(counts, KEY).withColumn("isolated", F.col("body") & (F.col("z") != 6) & F.col("__bad").isNull())
    flag = F.col("isolated").cast("int") * F.col("__n")
    return rows.withColumns({"isolatedDefect": F.try_divide(flag, "__body"), "isolatedDefectRatio": F.try_divide(flag, "__defects")}).drop("__bad", "__n", "__body", "__defects")


def dense_variants(orders: DataFrame, edges: DataFrame) -> DataFrame:
    """``raw_dense_1`` (all rods within the sparse distance), ``dense`` (raw_dense after one vote), ``dense_1`` (raw_dense_1 after three)."""
    rows = orders.select(*KEY, "pid", "raw_dense", (F.col("FarthestSegmentDist") <= SEGDIST_SPARSE).cast("int").alias("raw_dense_1"))
    one = vote(rows.select(*KEY, "pid", F.col("raw_dense").alias("dense")), edges, "dense", 1)
    three = vote(rows.select(*KEY, "pid", F.col("raw_dense_1").alias("dense_1")), edges, "dense_1", 3)
    return rows.join(one, [*KEY, "pid"]).join(three, [*KEY, "pid"])


def windings(bonds: DataFrame) -> DataFrame:
    """Sum of axis steps around the ring of neighbours, in units of pi; null where a step is half a turn."""
    ring = Window.partitionBy(*KEY, "i").orderBy("bond")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = bonds.withColumn("__u", axis_angle("tj") / math.pi).withColumn("__v", F.coalesce(F.lead("__u").over(ring), F.first("__u").over(whole)))
    step = F.col("__v") - F.col("__u")
    rows = rows.withColumn("__s", F.when(step > 0.5, step - 1).when(step < -0.5, step + 1).otherwise(step))
    bad = F.max(F.when(F.abs(F.abs("__s") - 0.5) <= 1e-4, 1).otherwise(0))
    return rows.groupBy(*KEY, F.col("i").alias("pid")).agg(F.when(bad == 0, F.round(F.sum("__s"))).cast("int").alias("winding"))


def bond_changes(edges: DataFrame) -> DataFrame:
    """Bonds that the next state has and this one has not, and the reverse: ``change`` 1 or -1 at the later state."""
    now = edges.select(*KEY, "i", "j")
    before = now.withColumn("idx", F.col("idx") + 1)
    states = now.select(*KEY).distinct()
    pairs = states.join(states.withColumn("idx", F.col("idx") + 1), KEY)
    made = now.join(before, [*KEY, "i", "j"], "left_anti").join(pairs, KEY).withColumn("change", F.lit(1))
    lost = before.join(now, [*KEY, "i", "j"], "left_anti").join(pairs, KEY).withColumn("change", F.lit(-1))
    return made.unionByName(lost)
