"""Order parameters by name, over one graph."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.config import KEY
from rodfield.functions import hooks
from rodfield.functions.columns import ellipse_distance, r_phi
from rodfield.operators import graph as N
from rodfield.operators import order as D
from rodfield.operators import select as B
from rodfield.operators import structure as S

PID = [*KEY, "pid"]


@dataclass
class Graph:
    """Particles (K, pid, x, y, t, gamma), edges (K, i, j) and states (K, n, a, b, phi); what several order parameters need is planned once."""

    particles: DataFrame
    edges: DataFrame
    states: DataFrame
    made: dict[str, DataFrame] = field(default_factory=dict)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = build()
        return self.made[name]

    def bonds(self) -> DataFrame:
        return self.once("bonds", lambda: N.directed_bonds(self.particles, self.edges))

    def orders(self, boundary: bool = False) -> DataFrame:
        """The order parameters of the graph. Without the boundary, which only C6 needs, no lists of neighbours are dealt; once made with it, they serve all."""
        if boundary or "bounded" in self.made:
            return self.once("bounded", lambda: N.order_parameters(self.particles, self.edges))
        return self.once("orders", lambda: N.order_parameters(self.particles, self.edges, boundary=False))

    def boxed(self) -> DataFrame:
        columns = [c for c in self.states.columns if c in KEY or c not in self.particles.columns]
        return self.particles.join(self.states.select(*columns), KEY)

    def isolated(self) -> DataFrame:
        body = self.boxed().select(*PID, (ellipse_distance("x", "y", "a", "b") >= 2).alias("body"))
        return self.once("isolated", lambda: N.isolated_defects(self.orders().select(*PID, "z").join(body, PID), self.edges))

    def dense(self) -> DataFrame:
        return self.once("dense", lambda: N.dense_variants(self.orders(), self.edges))


def _column(rows: DataFrame, name: str, source: str | None = None) -> DataFrame:
    return rows.select(*PID, F.col(source or name).alias(name))


def _masks(g: Graph, name: str) -> DataFrame:
    high = F.col("S_local") > 0.9
    other = F.col("EllipticPhi6") > 0.9 if name == "Phi_S_mask" else F.col("z") == 6
    return g.orders().select(*PID, F.coalesce(high & other, F.lit(False)).alias(name))


#: Names that one table gives together.
PLAIN = ("C6", "C6_raw", "Phi4", "Phi6", "EllipticPhi6", "PureRotationAngle", "S_center", "S_local", "DirectorAngle", "CrystalNematicAngle", "FarthestSegmentDist", "MeanSegmentDist", "raw_dense")
ISOLATED, DENSE = ("isolatedDefect", "isolatedDefectRatio"), ("raw_dense_1", "dense", "dense_1")
TOGETHER: list[tuple[tuple[str, ...], Callable[[Graph], DataFrame]]] = [(PLAIN, Graph.orders), (ISOLATED, Graph.isolated), (DENSE, Graph.dense)]

#: Names whose column follows from the particles alone, without a look at others by id.
ALONE: dict[str, Callable[[DataFrame], DataFrame]] = {"Angle": D.angle, "S_x": D.s_x, "S_global": D.s_global}
BOUNDED = ("C6", "defect")

#: From any other name to what gives its column.
ORDERS: dict[str, Callable[[Graph, str], DataFrame]] = {
    "YRank": lambda g, n: _column(B.y_rank_mask(g.boxed(), r_phi("phi") * F.col("n")), n, "y_rank"),
    "FittedEllipticPhi6": lambda g, n: _column(S.fitted_elliptic_phi6(g.bonds()), n, "order"),
    "winding2": lambda g, n: _column(N.windings(g.bonds()), n, "winding"),
    "SegmentDistRankMask": lambda g, n: _column(S.segment_rank_mask(g.orders(), g.edges, g.states), n, "flag"),
    "defect": lambda g, n: g.orders().select(*PID, (1 - F.col("C6")).alias(n)),
    **dict.fromkeys(("Phi_S_mask", "C6_S_mask"), _masks),
}


def _one(g: Graph, name: str) -> DataFrame:
    if name in ORDERS:
        return ORDERS[name](g, name)
    if m := re.fullmatch(r"Phi(\d+)Complex", name):
        return _column(N.bond_order(g.bonds(), int(m[1])), name, "phi")
    if m := re.fullmatch(r"director-(\d+)", name):
        return _column(S.director(g.particles, g.edges, int(m[1])), name, "angle")
    return _column(hooks.order_parameter(g.particles, name), name)


def names() -> list[str]:
    """All names but those with a number in them and those of a user."""
    return [*(n for group, _ in TOGETHER for n in group), *ALONE, *ORDERS]


def by_name(graph: Graph, names: list[str]) -> DataFrame:
    """The particles with a column for each named order parameter: one of :func:`names`, ``Phi<p>Complex``, ``director-<k>``, or a
    name that a user has registered. Another name is an error."""
    together = [n for group, _ in TOGETHER for n in names if n in group]
    columns = [*graph.particles.columns, *together, *(n for n in names if n not in together)]
    if any(n in BOUNDED for n in names):
        graph.orders(boundary=True)
    # columns of their own rows first, where nothing is joined yet
    rows = reduce(lambda rows, n: ALONE[n](rows), [n for n in names if n in ALONE], graph.particles)
    for group, source in TOGETHER:
        if wanted := [n for n in names if n in group]:
            rows = rows.join(source(graph).select(*PID, *wanted), PID, "left")
    rest = [n for n in names if n not in together and n not in ALONE]
    return reduce(lambda rows, n: rows.join(_one(graph, n), PID, "left"), rest, rows).select(*columns)
