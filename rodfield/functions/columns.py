"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rodfield.config import PHI_0, PHI_C


def to_col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def axis_angle(t) -> Column:
    """An angle modulo pi."""
    return F.pmod(to_col(t), F.lit(math.pi))


def reference_phi(gamma, h) -> Column:
    """Packing fraction at compression depth h."""
    g = to_col(gamma)
    return (math.pi + 4 * (g - 1)) / (2 * g * (2 - to_col(h)))


def packing_fraction(rho, gamma) -> Column:
    g = to_col(gamma)
    return to_col(rho) * (math.pi + 4 * (g - 1)) / (g * g)


def number_density(n, a, b) -> Column:
    return to_col(n) / (math.pi * to_col(a) * to_col(b))


def gamma_star(gamma) -> Column:
    return to_col(gamma) * math.sqrt(3) / 2


def r_phi(phi) -> Column:
    """Share of particles that count as inner at a packing fraction; 1 from the critical one on."""
    p = to_col(phi)
    return F.when(p < PHI_C, (p - PHI_0) / (PHI_C - PHI_0) * PHI_C / p).otherwise(1.0)


def h_ref(gamma, rho) -> Column:
    g = to_col(gamma)
    return (1 + g) - F.sqrt((g - 1) * (g - 1) + 1 / to_col(rho))


def box_axes(n, gamma, phi, ratio) -> tuple[Column, Column]:
    """Semi-axes of the box with a target packing fraction."""
    g, q = to_col(gamma), to_col(ratio)
    b = F.sqrt(to_col(n) * (math.pi + 4 * (g - 1)) / (math.pi * q * to_col(phi))) / g
    return q * b, b


def histogram_bin(v, low, high, bins) -> Column:
    """Bin number of a value in [low, high], the last bin closed; null outside."""
    x, a, b = to_col(v), to_col(low), to_col(high)
    return F.when((x >= a) & (x <= b) & (b > a), F.least(F.floor((x - a) / (b - a) * bins), F.lit(bins - 1))).cast("int")


def ellipse_distance(x, y, a, b, steps: int = 16) -> Column:
    """Distance to an ellipse by Newton steps on the foot's parameter, ended once the residual is small."""
    px, py, pa, pb = F.abs(to_col(x)), F.abs(to_col(y)), to_col(a), to_col(b)
    start = F.when(pa < pb, -pa * pa + pa * px).otherwise(-pb * pb + pb * py)

    def step(s: Column, _: Column) -> Column:
        u, v = pa * pa + s, pb * pb + s
        ga, gb = F.try_divide(pa * px, u), F.try_divide(pb * py, v)
        g = ga * ga + gb * gb - 1
        slope = -2 * (F.try_divide(pa * px * pa * px, u * u * u) + F.try_divide(pb * py * pb * py, v * v * v))
        return F.when((g < 1e-3) | g.isNull(), s).otherwise(F.coalesce(s - F.try_divide(g, slope), s))

    def foot(t: Column) -> Column:
        fx, fy = F.coalesce(F.try_divide(pa * pa * px, pa * pa + t), F.lit(0.0)), F.coalesce(F.try_divide(pb * pb * py, pb * pb + t), F.lit(0.0))
        return F.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, foot)


def end_to_segment(ex, ey, x, y, t, r) -> Column:
    """Distance of a point to a segment with centre (x, y), angle t and half-length r."""
    dx, dy = to_col(ex) - to_col(x), to_col(ey) - to_col(y)
    along, across = dx * F.cos(t) + dy * F.sin(t), -dx * F.sin(t) + dy * F.cos(t)
    past = F.greatest(F.abs(along) - to_col(r), F.lit(0.0))
    return F.sqrt(past * past + across * across)


def segment_distance(r, x1, y1, t1, x2, y2, t2) -> Column:
    """Distance between two segments of half-length r; 0 where they cross."""
    t1, t2 = to_col(t1), to_col(t2)
    return turned_distance(r, x1, y1, F.cos(t1), F.sin(t1), x2, y2, F.cos(t2), F.sin(t2))


def turned_distance(r, x1, y1, c1, s1, x2, y2, c2, s2) -> Column:
    """The same of segments whose angles are given by cosine and sine, which then are taken once a segment and not for each pair."""
    r, x1, y1, c1, s1, x2, y2, c2, s2 = map(to_col, (r, x1, y1, c1, s1, x2, y2, c2, s2))
    dx, dy = x2 - x1, y2 - y1
    turn, side = s1 * c2 - c1 * s2, c1 * c2 + s1 * s2
    reach = F.abs(r * turn)
    along, across = (dx * c1 + dy * s1, dx * c2 + dy * s2), (dy * c1 - dx * s1, dy * c2 - dx * s2)
    boxes = (F.abs(dx) <= r * (F.abs(c1) + F.abs(c2))) & (F.abs(dy) <= r * (F.abs(s1) + F.abs(s2)))
    cross = boxes & (F.abs(across[0]) <= reach) & (F.abs(across[1]) <= reach) & (reach > 0)

    def end(k: int, q: int) -> Column:
        """An end of the other segment from this one, squared."""
        past = F.greatest(F.abs(along[k] + q * r * side) - r, F.lit(0.0))
        aside = across[k] + (-q if k == 0 else q) * r * turn
        return past * past + aside * aside

    return F.when(cross, 0.0).otherwise(F.sqrt(F.least(*[end(k, q) for k in (0, 1) for q in (-1, 1)])))
