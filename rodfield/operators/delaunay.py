"""Triangulation of states, local: every point finds the fan of triangles around itself.

States are cut into tiles of a quadtree, each of few points however dense they lie. A tile's points look at the points in a margin
around it. A point's nearest neighbour is joined to it in the triangulation; from one joined neighbour to the next, the apex of
the triangle over their edge is the point that sees the edge under the largest angle. So a fan takes as many steps as it has
triangles, each over the points in sight, and tasks take many points at a time as numpy matrices. Which side a point lies on and
whether it lies in a circle is decided in floating point where that is certain and in whole numbers where it is not.

A fan is right if no tile that is not wholly in sight meets one of its circles (an open fan, on the hull: the half-planes beyond
its ends). Circles are held against the tiles' boxes by joins on cells of the quadtree; a tile takes in only those that an open circle
meets, the nearest first, and its open points are tried again, until none is left. There is no other end: a result is complete. So
voids, lines of points and clusters cost what their circles meet, never a look at a whole state. More points only make a fan's circles
lie within those that it had, so a point that is tried again needs what lies within twice its largest circle's radius, and no more is sent.

Each triangle comes from its point of least id among the real ones. Of points on one circle a fan takes each in turn, and
only that of the least of them counts there. Points at one place see the others, not each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.plans.lineage import stored

#: Cells of the matrices of one step, how many of the nearest points a fan is looked for in before all, most points of a tile, and how
#: many of the tiles that a point's circles meet are taken in at a time.
CELLS, NEAREST, TILE, TAKEN = 200_000, (48, 192), 384, 4
#: How far around its cell a tile looks first, in widths of that cell.
MARGIN = 0.4
#: Levels of the quadtree, and how many of them are counted at a time.
DEPTH, STRIDE = 24, 6
#: Circles wider than this, in widths of what is in sight, count as half-planes.
FLAT = 1e5
OWN = ["lv", "cx", "cy"]


def whole_numbers(*points: tuple[float, float]) -> list[tuple[int, int]]:
    """Coordinates times one power of two that makes all of them whole."""
    ratios = [(float(x).as_integer_ratio(), float(y).as_integer_ratio()) for x, y in points]
    common = max(d for r in ratios for _, d in r)
    return [(a * (common // b), c * (common // d)) for (a, b), (c, d) in ratios]


def side_of(o: tuple[int, int], p: tuple[int, int], q: tuple[int, int]) -> int:
    """Positive if o, p, q turn to the left, exactly."""
    return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])


def inside(o: tuple[int, int], p: tuple[int, int], q: tuple[int, int], s: tuple[int, int]) -> int:
    """Positive if s lies in the circle of o, p, q, which turn to the left; 0 on it; exactly."""
    (a, b), (c, d), (e, f) = ((x - s[0], y - s[1]) for x, y in (o, p, q))
    return (a * a + b * b) * (c * f - d * e) - (c * c + d * d) * (a * f - b * e) + (e * e + f * f) * (a * d - b * c)


def _apex(o, p, found: list[int], places: list[tuple[float, float]], sign: int) -> int | None:
    """Of candidates the one that sees the edge from o to p from its left (sign 1) under the largest angle; of those on one circle the first in turn."""
    o, p, *places = whole_numbers(o, p, *places)
    best = None
    for k, q in zip(found, places, strict=True):
        if sign * side_of(o, p, q) <= 0:
            continue
        if best is not None:
            within = inside(o, p, best[1], q) * sign
            if within < 0 or within == 0 and sign * side_of(o, q, best[1]) <= 0:
                continue
        best = (k, q)
    return None if best is None else best[0]


def fans(ox: np.ndarray, oy: np.ndarray, x: np.ndarray, y: np.ndarray, seen: np.ndarray, names: np.ndarray) -> dict[str, np.ndarray]:
    """Fans of points at (ox, oy) whose neighbours lie at (x, y), a row each; ``seen``: which entries are neighbours. Per triangle its
    ``row``, ``one``, ``two`` (entries of neighbour and apex), ``low`` (the least name on its circle), the circle's centre from the point (``u``, ``v``)
    and radius ``r``; per end of an open fan its ``end_row``, and the direction out of it (``end_u``, ``end_v``)."""
    n = len(ox)
    u, v = x - ox[:, None], y - oy[:, None]
    far = np.where(seen, u * u + v * v, np.inf)
    root = np.sqrt(far)
    some = np.isfinite(far.min(1)) if n else np.empty(0, bool)
    first = far.argmin(1) if n else np.empty(0, np.int64)
    made: dict[str, list] = {k: [] for k in ("row", "one", "two", "low", "u", "v", "r", "end_row", "end_u", "end_v")}
    alone = np.flatnonzero(~some)
    for side in (1.0, -1.0):  # nothing seen: nothing known on either side
        made["end_row"].append(alone), made["end_u"].append(np.full(len(alone), side)), made["end_v"].append(np.zeros(len(alone)))
    closed = np.zeros(n, bool)
    for sign in (1.0, -1.0):  # to the left all round; fans that end there, to the right from the start too
        live = np.flatnonzero(some & ~closed)
        at = first[live]
        while len(live):
            cu, cv = u[live, at][:, None], v[live, at][:, None]
            uu, vv, size, length, can = u[live], v[live], far[live], root[live], seen[live]
            cross, dot = sign * (cu * vv - cv * uu), cu * uu + cv * vv
            reach, off = np.sqrt(cu * cu + cv * cv), 1e-13 * (np.abs(ox[live]) + np.abs(oy[live]))[:, None]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                # what a rounded cross product may be off by: of its factors, and of the differences that these are
                unsure = (1e-14 * reach + off) * length + off * reach
                ahead, flat = can & (cross > unsure), can & (np.abs(cross) <= unsure) & ((uu != cu) | (vv != cv))
                cot = np.where(ahead, (size - dot) / cross, np.inf)
                least = cot.min(1, keepdims=True)
                # a flat one counts where it lies between the ends of the edge, or where nothing better is there
                rival = ahead & (cot <= least + 1e-9 * (1 + np.abs(least))) | flat & ((size <= dot) | (least > 1e6))
            apex = cot.argmin(1)
            found = np.isfinite(least[:, 0])
            for k in np.flatnonzero(rival.sum(1) > 1 - (flat & rival).any(1)):
                held = np.flatnonzero(rival[k]).tolist()
                row = live[k]
                best = _apex((ox[row], oy[row]), (x[row, at[k]], y[row, at[k]]), held, [(x[row, c], y[row, c]) for c in held], int(sign))
                found[k] = best is not None
                apex[k] = apex[k] if best is None else best
            out = ~found
            made["end_row"].append(live[out]), made["end_u"].append(-sign * cv[out, 0]), made["end_v"].append(sign * cu[out, 0])
            live, at, apex = live[found], at[found], apex[found]
            du, dv, au, av = u[live, at], v[live, at], u[live, apex], v[live, apex]
            one, two = du * du + dv * dv, au * au + av * av
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                # which side the apex lies on is certain; what is flatter than can be told has a circle as wide as can be held
                area = 2 * sign * np.maximum(np.abs(du * av - dv * au), 1e-20 * (one + two))
                cx, cy = (one * av - two * dv) / area, (two * du - one * au) / area
                r2 = cx * cx + cy * cy
                uu, vv = u[live] - cx[:, None], v[live] - cy[:, None]
                near = seen[live] & ~(np.abs(uu * uu + vv * vv - r2[:, None]) > 1e-7 * r2[:, None])
            near[np.arange(len(live)), at] = near[np.arange(len(live)), apex] = False
            low = np.minimum(names[live, at], names[live, apex])
            near &= names[live] < low[:, None]
            k, c = np.nonzero(near)
            # a flat circle passes near all that lies about its line: the determinant tells, but for what its terms may be rounded by
            su, sv, pu, pv, qu, qv, pp, qq = u[live[k], c], v[live[k], c], du[k], dv[k], au[k], av[k], one[k], two[k]
            with np.errstate(invalid="ignore", over="ignore"):
                ss = su * su + sv * sv
                turn = np.abs(ss * (pu * qv - pv * qu) - su * (pp * qv - qq * pv) - sv * (qq * pu - pp * qu))
                terms = ss * (np.abs(pu * qv) + np.abs(pv * qu)) + np.abs(su) * (pp * np.abs(qv) + qq * np.abs(pv)) + np.abs(sv) * (qq * np.abs(pu) + pp * np.abs(qu))
                open_ = ~(turn > 1e-14 * terms) | (terms < 1e-280)
            for k, c in zip(k[open_], c[open_], strict=True):
                row = live[k]
                if names[row, c] < low[k]:
                    o, p, q, s = whole_numbers((ox[row], oy[row]), (x[row, at[k]], y[row, at[k]]), (x[row, apex[k]], y[row, apex[k]]), (x[row, c], y[row, c]))
                    if inside(o, p, q, s) == 0:
                        low[k] = names[row, c]
            for name, value in (("row", live), ("one", at), ("two", apex), ("low", low), ("u", cx), ("v", cy), ("r", np.sqrt(r2))):
                made[name].append(value)
            end = apex == first[live]
            closed[live[end]] = True
            live, at = live[~end], apex[~end]
    kinds = {"row": np.int64, "one": np.int64, "two": np.int64, "low": np.int64, "end_row": np.int64}
    return {k: np.concatenate([np.empty(0, kinds.get(k, float)), *parts]) for k, parts in made.items()}


#: A row of a try: a triangle (or none) of an own point, and unless ``sure`` what must be empty for it: a circle (r), or what lies beyond
#: a line through (x, y), further than -r, in the direction (nx, ny). Where a point has a row that is not sure, ``need``: how far from its place (ox, oy)
#: what bears on its fan may lie.
_TRIED = "pid bigint, a bigint, b bigint, c bigint, sure boolean, x double, y double, r double, nx double, ny double, need double, ox double, oy double"


def _fan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From tiles, with their own open points and all points in sight, to the rows of a try."""
    def flat(lists: pa.ListArray) -> tuple[np.ndarray, ...]:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        inner = lists.flatten()
        return sizes, *(inner.field(c).to_numpy(zero_copy_only=False) for c in ("pid", "x", "y"))

    for batch in batches:
        owned, pid, ox, oy = flat(batch.column("own"))
        held, ids, nx, ny = flat(batch.column("near"))
        cell = np.repeat(np.arange(batch.num_rows), owned)
        box = [batch.column(c).to_numpy(zero_copy_only=False)[cell] for c in ("x0", "y0", "x1", "y1")]
        sizes, begins = held[cell], (np.cumsum(held) - held)[cell]

        def looked(part: np.ndarray, most: int | None) -> tuple[np.ndarray, pa.RecordBatch]:
            """Fans of some points over the ``most`` nearest in sight, or all; the points that need them all, and rows for the others."""
            width = int(sizes[part].max())
            at = np.minimum(begins[part][:, None] + np.arange(width), len(ids) - 1)
            far = np.hypot(nx[at] - ox[part][:, None], ny[at] - oy[part][:, None])
            seen = (np.arange(width) < sizes[part][:, None]) & (far > 0)
            span = np.where(seen, far, 0).max(1, initial=0)
            sight = np.full(len(part), np.inf)
            if most:
                far = np.where(seen, far, np.inf)
                nearest = np.argpartition(far, most, axis=1)
                # what is nearer than the nearest one left out has been taken
                sight = far[np.arange(len(part)), nearest[:, most]]
                at, seen = (np.take_along_axis(z, nearest[:, :most], 1) for z in (at, seen))
            names = np.where(ids[at] < 0, np.iinfo(np.int64).max, ids[at])
            f = fans(ox[part], oy[part], nx[at], ny[at], seen, names)
            row, end = f["row"], f["end_row"]
            # fans over the nearest points are certain where all their circles are in what these cover
            bad = np.bincount(row, ~(2.000001 * f["r"] < sight[row]), len(part)) + (np.bincount(end, minlength=len(part)) if np.isfinite(sight).any() else 0) * np.isfinite(sight) if most else np.zeros(len(part))
            left = np.zeros(len(part), bool) | (bad > 0) if most else np.zeros(len(part), bool)
            px, py = ox[part], oy[part]
            with np.errstate(invalid="ignore", over="ignore"):
                cx, cy, r = px[row] + f["u"], py[row] + f["v"], f["r"] * (1 + 1e-6)
                lo_x, lo_y, hi_x, hi_y = (b[part][row] for b in box)
                sure_circle = (cx - r >= lo_x) & (cx + r <= hi_x) & (cy - r >= lo_y) & (cy + r <= hi_y)
            open_ = np.bincount(row, ~sure_circle, len(part)) + np.bincount(end, minlength=len(part)) > 0
            widest = np.zeros(len(part))
            np.maximum.at(widest, row, np.where(f["r"] <= FLAT * span[row], f["r"], np.inf))
            widest[end] = np.inf
            need = np.where(open_, 2 * (1 + 1e-6) * widest + 1e-12 * (np.abs(px) + np.abs(py)), np.nan)
            a, b, c = pid[part][row], ids[at[row, f["one"]]], ids[at[row, f["two"]]]
            ours = a < f["low"]
            keep = np.flatnonzero(~left[row] & (ours | open_[row] & ~sure_circle))
            tri = np.sort(np.stack([a, b, c], 1), axis=1)[keep]
            wide = ~(f["r"][keep] <= FLAT * span[row[keep]])
            longest = np.hypot(span[row[keep]], 0)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                length = np.hypot(f["u"][keep], f["v"][keep])
                du, dv = f["u"][keep] / length, f["v"][keep] / length
                # a flat circle's centre is too far to be told; the side of its far point is
                slack = longest * longest / f["r"][keep]
            unclear = wide & ~np.isfinite(du + dv)
            du, dv, slack = np.where(unclear, 1.0, du), np.where(unclear, 0.0, dv), np.where(unclear, np.inf, slack + 1e-9 * longest)
            ends = np.flatnonzero(~left[end])
            made = {
                "pid": np.concatenate([a[keep], pid[part][end[ends]]]), "sure": np.concatenate([~open_[row[keep]], np.zeros(len(ends), bool)]),
                "x": np.concatenate([np.where(wide, px[row[keep]], cx[keep]), px[end[ends]]]), "y": np.concatenate([np.where(wide, py[row[keep]], cy[keep]), py[end[ends]]]),
                "r": np.concatenate([np.where(wide, slack, r[keep]), np.zeros(len(ends))]), "nx": np.concatenate([np.where(wide, du, np.nan), f["end_u"][ends]]), "ny": np.concatenate([np.where(wide, dv, np.nan), f["end_v"][ends]]),
            }
            of = np.concatenate([row[keep], end[ends]])
            # what is sure is asked of no tile
            made |= {k: np.where(made["sure"], np.nan, made[k]) for k in ("x", "y", "r", "nx", "ny")}
            made |= {"need": need[of], "ox": np.where(open_[of], px[of], np.nan), "oy": np.where(open_[of], py[of], np.nan)}
            mine = ours[keep]
            corners = [pa.array(np.concatenate([tri[:, k], np.zeros(len(ends), np.int64)]), mask=np.concatenate([~mine, np.ones(len(ends), bool)])) for k in range(3)]
            source = pa.array(np.concatenate([cell[part[row[keep]]], cell[part[end[ends]]]]))
            columns = [*(batch.column(k).take(source) for k in (*KEY, *OWN)), pa.array(made["pid"]), *corners, pa.array(made["sure"]), *(pa.array(made[k], from_pandas=True) for k in ("x", "y", "r", "nx", "ny", "need", "ox", "oy"))]
            return part[left], pa.RecordBatch.from_arrays(columns, [*KEY, *OWN, "pid", "a", "b", "c", "sure", "x", "y", "r", "nx", "ny", "need", "ox", "oy"])

        left = np.arange(len(pid))
        for most in (*NEAREST, None):
            order, start, open_points = left[np.argsort(sizes[left], kind="stable")], 0, []
            while start < len(order):
                stop = start + 1
                while stop < len(order) and (stop + 1 - start) * sizes[order[stop]] <= CELLS:
                    stop += 1
                again, rows = looked(order[start:stop], most if most and sizes[order[start]] > 1.5 * most else None)
                open_points.append(again)
                yield rows
                start = stop
            left = np.concatenate([np.empty(0, np.int64), *open_points])


def frames(points: DataFrame) -> DataFrame:
    """Per state its lower left corner and the width of the square that its quadtree divides."""
    wide = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return points.groupBy(*KEY).agg(F.min("x").alias("fx"), F.min("y").alias("fy"), F.greatest(wide, F.lit(1e-300)).alias("fw"))


def _cell(column: str, corner: str):
    """A coordinate's cell at the deepest level."""
    return F.least(F.floor((F.col(column) - F.col(corner)) / F.col("fw") * float(1 << DEPTH)).cast("int"), F.lit((1 << DEPTH) - 1))


def tiled(points: DataFrame, frame: DataFrame) -> DataFrame:
    """Points with their tile (``lv``, ``cx``, ``cy``): the largest cell of the quadtree around them with at most TILE points. Points at one place stay together."""
    rows = points.join(frame, KEY).withColumns({"ux": _cell("x", "fx"), "uy": _cell("y", "fy")}).select(*points.columns, "ux", "uy")
    done, level = None, 0
    while True:
        last = min(level + STRIDE, DEPTH)
        fine = rows.groupBy(*KEY, F.shiftright("ux", DEPTH - last).alias("gx"), F.shiftright("uy", DEPTH - last).alias("gy")).agg(F.count("*").alias("n"))
        up = fine.withColumn("lv", F.explode(F.sequence(F.lit(level), F.lit(last)))).withColumns({c: F.expr(f"shiftright({g}, {last} - lv)") for c, g in (("cx", "gx"), ("cy", "gy"))})
        fit = up.groupBy(*KEY, *OWN).agg(F.sum("n").alias("all")).where(F.col("all") <= TILE)
        chosen = stored(fine.join(up.join(fit, [*KEY, *OWN]).groupBy(*KEY, "gx", "gy").agg(F.min("lv").alias("lv")), [*KEY, "gx", "gy"], "left").select(*KEY, "gx", "gy", F.coalesce("lv", F.lit(DEPTH if last == DEPTH else -1)).alias("lv")))
        met = rows.withColumns({"gx": F.shiftright("ux", DEPTH - last), "gy": F.shiftright("uy", DEPTH - last)}).join(chosen, [*KEY, "gx", "gy"]).drop("gx", "gy")
        found = met.where("lv >= 0").withColumns({c: F.expr(f"shiftright({g}, {DEPTH} - lv)") for c, g in (("cx", "ux"), ("cy", "uy"))}).drop("ux", "uy")
        done = found if done is None else done.unionByName(found)
        if chosen.where("lv < 0").isEmpty():
            return done
        rows, level = stored(met.where("lv < 0").drop("lv")), last


def meeting(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes (``bx0``, ``by0``, ``bx1``, ``by1``, beside other columns) with each tile that may meet them, as ``t_lv``, ``t_cx``, ``t_cy`` and its box. Both sides of the equi-join
    are cells of the quadtree: a box looks in the at most four cells of its size, for tiles in them and for tiles around them. A pair
    may come more than once."""
    wide = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"), F.lit(1e-300))
    level = F.greatest(F.lit(0), F.least(F.lit(DEPTH), F.floor(F.log2(F.col("fw") / wide)).cast("int")))
    many = F.expr("shiftleft(1, ql)")
    spread = boxes.withColumn("ql", level)
    for c, low, high, corner in (("qx", "bx0", "bx1", "fx"), ("qy", "by0", "by1", "fy")):
        cell = lambda v, corner=corner: F.least(F.greatest(F.floor((F.col(v) - F.col(corner)) / F.col("fw") * many), F.lit(0)), many - 1).cast("int")
        spread = spread.withColumn(c, F.explode(F.sequence(cell(low), cell(high))))
    named = tiles.select(*KEY, *[F.col(c).alias(f"t_{c}") for c in OWN], "tx0", "ty0", "tx1", "ty1")
    below = named.withColumn("ql", F.explode(F.sequence(F.lit(0), F.col("t_lv")))).withColumns({q: F.expr(f"shiftright({t}, t_lv - ql)") for q, t in (("qx", "t_cx"), ("qy", "t_cy"))})
    above = spread.where("ql > 0").withColumn("t_lv", F.explode(F.sequence(F.lit(0), F.col("ql") - 1))).withColumns({t: F.expr(f"shiftright({q}, ql - t_lv)") for q, t in (("qx", "t_cx"), ("qy", "t_cy"))})
    cells = ["ql", "qx", "qy"]
    found = spread.join(below, [*KEY, *cells]).drop(*cells).unionByName(above.drop(*cells).join(named, [*KEY, "t_lv", "t_cx", "t_cy"]))
    return found.where("tx0 <= bx1 and tx1 >= bx0 and ty0 <= by1 and ty1 >= by0")


def _unseen(tried: DataFrame, tiles: DataFrame, frame: DataFrame, known: DataFrame) -> DataFrame:
    """The tiles not wholly in sight that meet what must be empty: (K, tile, pid) with ``t_lv``, ``t_cx``, ``t_cy`` and their distance ``gap``."""
    asked = tried.where("not sure").select(*KEY, *OWN, "pid", "x", "y", "r", "nx", "ny", "need", "ox", "oy").join(frame, KEY)
    half = F.col("nx").isNotNull()
    ends = {n: F.when(half, F.col(c) + F.col("fw") * s).otherwise(F.col(v) + F.col("r") * k) for n, c, s, v, k in (("bx0", "fx", -1, "x", -1), ("by0", "fy", -1, "y", -1), ("bx1", "fx", 2, "x", 1), ("by1", "fy", 2, "y", 1))}
    met = meeting(asked.withColumns(ends), tiles)

    def gap(tx0, ty0, tx1, ty1):
        """From a circle's centre to a box, squared; null where the circle or half-plane does not meet it."""
        gx, gy = F.greatest(tx0 - F.col("x"), F.col("x") - tx1, F.lit(0.0)), F.greatest(ty0 - F.col("y"), F.col("y") - ty1, F.lit(0.0))
        corner = lambda n, low, high, at: F.greatest(F.col(n) * (low - F.col(at)), F.col(n) * (high - F.col(at)))
        beyond = corner("nx", tx0, tx1, "x") + corner("ny", ty0, ty1, "y") > -F.col("r")
        return F.when(F.when(half, beyond).otherwise(gx * gx + gy * gy <= F.col("r") * F.col("r")), gx * gx + gy * gy)

    box = [F.col(c) for c in ("tx0", "ty0", "tx1", "ty1")]
    met = met.withColumn("gap", gap(*box)).where("gap is not null").join(known.withColumn("seen", F.lit(True)), [*KEY, *OWN, "t_lv", "t_cx", "t_cy"], "left")
    # of a tile that is in sight in part, what lies on a side of that part
    (tx0, ty0, tx1, ty1), (x0, y0, x1, y1) = box, (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    sides = [F.when(tx0 < x0, gap(tx0, ty0, F.least(tx1, x0), ty1)), F.when(tx1 > x1, gap(F.greatest(tx0, x1), ty0, tx1, ty1)), F.when(ty0 < y0, gap(tx0, ty0, tx1, F.least(ty1, y0))), F.when(ty1 > y1, gap(tx0, F.greatest(ty0, y1), tx1, ty1))]
    new = met.withColumn("gap", F.when(F.col("seen").isNull(), F.col("gap")).when(x0.isNotNull(), F.least(*sides))).where("gap is not null")
    return new.groupBy(*KEY, *OWN, "pid", "t_lv", "t_cx", "t_cy").agg(F.min("gap").alias("gap"), *[F.first(c).alias(c) for c in ("need", "ox", "oy")])


def _tried(points: DataFrame, active: DataFrame, known: DataFrame, reach: DataFrame) -> DataFrame:
    """One try of the active tiles' points, with what these have in sight. A tile's points go to another as one list, cut to what that one asks for."""
    there = reach.select(*KEY, *[F.col(c).alias(f"t_{c}") for c in OWN], "points")
    # of known size, so that points are not dealt for few tiles
    seen = stored(known.join(active, [*KEY, *OWN])).join(there, [*KEY, "t_lv", "t_cx", "t_cy"])
    # no bound: all that the tile has
    low, high = ([f(f"{v}{k}", f"n{v}{k}") for v in "xy"] for f, k in ((F.greatest, 0), (F.least, 1)))
    asked = F.filter("points", lambda p: (p["x"] >= low[0]) & (p["x"] <= high[0]) & (p["y"] >= low[1]) & (p["y"] <= high[1]))
    home = (F.col("t_lv") == F.col("lv")) & (F.col("t_cx") == F.col("cx")) & (F.col("t_cy") == F.col("cy"))
    own = F.when(home, F.coalesce("own", F.filter("points", lambda p: p["pid"] >= 0)))
    sent = seen.select(*KEY, *OWN, asked.alias("near"), own.alias("own")).where("size(near) > 0 or own is not null")
    # few tiles make much work here: a fixed number of tasks, which small data would not get
    sent = sent.repartition(max(8, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *KEY, *OWN)
    met = sent.groupBy(*KEY, *OWN).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("own", "near")])
    met = met.join(reach.select(*KEY, *OWN, "x0", "y0", "x1", "y1"), [*KEY, *OWN]).select(*KEY, *OWN, "x0", "y0", "x1", "y1", "own", "near")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    return met.mapInArrow(_fan_rows, ", ".join(f"{c} {kinds[c]}" for c in (*KEY, *OWN)) + ", " + _TRIED)


def triangulate(points: DataFrame) -> DataFrame:
    """Triangles (a < b < c) of points (K, pid, x, y); negative ids are ring points, and triangles of these alone are left out."""
    points = points.select(*KEY, "pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    points = stored(points)
    frame = stored(frames(points))
    # a tile's points are gathered once, as a list
    bounds = [f(v).alias(f"t{v}{k}") for k, f in ((0, F.min), (1, F.max)) for v in "xy"]
    margin = F.expr(f"fw * {MARGIN} / shiftleft(1, lv)")
    box = {f"{v}{k}": F.col(f"t{v}{k}") + sign * margin for k, sign in ((0, -1), (1, 1)) for v in "xy"}
    reach = tiled(points, frame).groupBy(*KEY, *OWN).agg(F.collect_list(F.struct("pid", "x", "y")).alias("points"), *bounds).join(frame, KEY)
    reach = stored(reach.select("*", *[c.alias(n) for n, c in box.items()]))
    points, tiles = reach.select(*KEY, *OWN, F.inline("points")), stored(reach.select(*KEY, *OWN, "tx0", "ty0", "tx1", "ty1"))
    # in sight first: what lies in the margin, of tiles that may lie in it in part; no box: the whole tile
    known = meeting(reach.select(*KEY, *OWN, "fx", "fy", "fw", *[F.col(n).alias(f"b{n}") for n in box]), tiles)
    whole = F.expr("tx0 >= bx0 and ty0 >= by0 and tx1 <= bx1 and ty1 <= by1")
    known = stored(known.select(*KEY, *OWN, "t_lv", "t_cx", "t_cy", *[F.when(~whole, F.col(f"b{n}")).alias(n) for n in box]).distinct())
    every = {f"n{n}": F.lit(-math.inf if n.endswith("0") else math.inf) for n in box}
    active, found = reach.where(F.exists("points", lambda p: p["pid"] >= 0)).select(*KEY, *OWN, F.lit(None).cast(reach.schema["points"].dataType).alias("own"), *[c.alias(n) for n, c in every.items()]), None
    while True:
        tried = stored(_tried(points, active, known, reach))
        unseen = stored(_unseen(tried, tiles, frame, known))
        again = unseen.select(*KEY, "pid").distinct()
        made = tried.where("a is not null")
        made = made.where("need is null").unionByName(made.where("need is not null").join(again, [*KEY, "pid"], "left_anti")).select(*KEY, "a", "b", "c")
        found = made if found is None else found.unionByName(made)
        if unseen.isEmpty():
            return found
        nearest = F.row_number().over(Window.partitionBy(*KEY, *OWN, "pid").orderBy("gap", "t_lv", "t_cx", "t_cy"))
        pair = [*KEY, *OWN, "t_lv", "t_cx", "t_cy"]
        taken = stored(unseen.withColumn("k", nearest).where(F.col("k") <= TAKEN).select(*pair).distinct())
        one = unseen.groupBy(*KEY, *OWN, "pid").agg(*[F.first(c).alias(c) for c in ("need", "ox", "oy")])
        ends = [f(F.col(f"o{v}") + sign * F.col("need")).alias(f"n{v}{k}") for k, f, sign in ((0, F.min, -1), (1, F.max, 1)) for v in "xy"]
        active = stored(one.groupBy(*KEY, *OWN).agg(F.collect_list(F.struct("pid", F.col("ox").alias("x"), F.col("oy").alias("y"))).alias("own"), *ends))
        left = known.join(active.select(*KEY, *OWN), [*KEY, *OWN], "left_semi").join(taken, pair, "left_anti")
        known = stored(left.unionByName(taken.withColumns({n: F.lit(None).cast("double") for n in box})))


def edges_of(triangles: DataFrame) -> DataFrame:
    """Edges (i < j) between real points, and in how many triangles each is."""
    pairs = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("a").alias("i"), F.col("c").alias("j")), F.struct(F.col("b").alias("i"), F.col("c").alias("j"))))
    rows = triangles.select(*KEY, pairs.alias("e")).select(*KEY, "e.i", "e.j")
    return rows.where("i >= 0").groupBy(*KEY, "i", "j").agg(F.count("*").alias("triangles"))


def collapse(edges: DataFrame, rod) -> DataFrame:
    """Edges between disks to edges between rods, weighted by their contacts. ``rod``: from the column of a disk's id to its rod's."""
    a, b = rod(F.col("i")), rod(F.col("j"))
    return edges.select(*KEY, F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).where("i < j").groupBy(*KEY, "i", "j").agg(F.count("*").alias("w"))


def hull_points(triangles: DataFrame) -> DataFrame:
    """Points on edges that are in one triangle only."""
    return edges_of(triangles).where("triangles = 1").select(*KEY, F.explode(F.array("i", "j")).alias("pid")).distinct()
