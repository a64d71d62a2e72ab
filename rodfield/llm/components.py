"""Connected components of a large graph.

Large-star and small-star steps (Kiveris et al., 2014): each node's neighbours are linked
to the least node it knows, in turn for larger and for smaller neighbours, until the
edges are stars. Every step is a grouped minimum, which is summed up before the shuffle,
and a join with one row a node; nothing is gathered by node. Each round is cut by
checkpoint(); rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.llm._common import cut

ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v)."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (node, component), the component being its least node; only nodes with an edge to another."""
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(ROUNDS):
        after = cut(_star(_star(now, True), False))
        # edges are stars once no node is both the larger and the smaller end, and each larger end has one edge
        state = after.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        chained = after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        now = after
        if state["n"] == state["d"] and not chained:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_roots(left: list[int], right: list[int], size: int) -> list[int]:
    """Union-find inside a block: the least index reachable from each of ``size`` nodes."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left, right, strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(size)]
