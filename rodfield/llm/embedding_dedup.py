"""Embedding near-dedup by spherical k-means cells.

Unit vectors are assigned to the nearest of a number of centroids, which are fitted by
spherical k-means on a bounded, documented sample (``SAMPLE`` vectors by id hash). Links
(cosine of at least the threshold) may cross cells, so a vector also visits each cell
whose border it is near: if y belongs to c' and x to c, then x.(c - c') >= 0, and
|x - y| <= d gives y.(c' - c) <= d |c - c'|, where d is the distance at the threshold.
That bound is exact, so that no link is lost. In each cell cosines are computed in
blocked matrix products: blocks of members against blocks of members and visitors, in
single precision with a margin, then in double precision for what is near the threshold
or above. Every member counts its own links in its own cell, once.

Equal vectors are one point with a weight. A cell's blocks are spread over tasks, so a
cell with a third of all vectors is many tasks; a task holds two blocks at a time. Links
leave a block as counts and as a spanning forest, never as pairs.

Defined results: null, zero, or non-finite vectors (also ones with null components)
have no links and stay; vectors of another length are compared with none but their own
length; rows that share an id, or have none, are rows of their own with the links of their
vectors; a component is named by the least id in it, and by null only if it has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.llm._common import cut
from rodfield.llm.components import components, local_roots

THRESHOLD = 0.95
#: Vectors of the sample that centroids are fitted on, rounds of k-means, vectors per cell aimed at, most cells, and the
#: rows of blocks of members and of blocks of members and visitors.
SAMPLE, ROUNDS, PER_CELL, MOST, LEFT, RIGHT = 20_000, 8, 8192, 512, 2048, 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors; a cell that empties takes the vector farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        dots = x @ c.T
        own = dots.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        worst = np.argsort(dots[np.arange(len(x)), own])
        for n, i in enumerate(np.flatnonzero(norms == 0)):
            sums[i], norms[i] = x[worst[n]], 1.0
        c = sums / norms[:, None]
    return c


def _points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Keys and vectors of rows whose vector is finite and isn't zero."""
    norm = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    good = F.col("v").isNotNull() & ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (F.col("norm") > 0)
    return df.select(F.col(key).alias("id"), F.col(vector).alias("v"), norm.alias("norm")).where(good).select("id", "v")


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _gaps(c: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from each other, too large by at most some 1e-6, never too small: cells x cells, whatever their length."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)) + 1e-12)


def _assign(points: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """For each point its cell, and the cells that it visits."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    sent = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        between = {}
        for batch in batches:
            for size, part in batch.groupby(batch["v"].map(len)):
                c = sent.value.get(size)
                if c is None:
                    c = np.eye(1, size)
                if size not in between:
                    between[size] = _gaps(c)
                gaps = between[size]
                for start in range(0, len(part), 4096):
                    rows = part.iloc[start : start + 4096]
                    dots = _unit(rows["v"].tolist()) @ c.T
                    own = dots.argmax(1)
                    near = dots[np.arange(len(rows)), own][:, None] - dots <= reach * gaps[own]
                    near[np.arange(len(rows)), own] = True
                    row, cell = np.nonzero(near)
                    at = rows.iloc[row]
                    yield pd.DataFrame({"id": at["id"].to_numpy(), "v": at["v"].to_numpy(), "weight": at["weight"].to_numpy(), "cell": size * MOST + cell, "member": own[row] == cell})

    return points.mapInPandas(run, f"id long, v {points.schema['v'].dataType.simpleString()}, weight long, cell long, member boolean")


def _above(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the product of unit vectors that are not below the threshold."""
    rows, cols = [], []
    one, two = x.astype(np.float32), y.astype(np.float32).T
    for start in range(0, len(x), 512):
        row, col = np.nonzero(one[start : start + 512] @ two >= np.float32(threshold - 1e-4))
        for part in range(0, len(row), 1 << 18):
            r, c = row[part : part + (1 << 18)] + start, col[part : part + (1 << 18)]
            exact = np.einsum("ij,ij->i", x[r], y[c]) >= threshold
            rows.append(r[exact]), cols.append(c[exact])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cols])


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """The key and, per row, ``n_links``, ``component_id`` and ``kept``."""
    rows = _points(df, key, vector)
    # a point's number of its own is stable, as what it counts lies in the checkpoint
    points = cut(rows.groupBy("v").agg(F.min("id").alias("name"), F.count("*").alias("weight"))).withColumn("id", F.monotonically_increasing_id())
    sizes = {r["n"]: r["rows"] for r in points.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows")).limit(64).collect()}
    centroids = {}
    for n, count in sizes.items():
        sample = points.where(F.size("v") == n).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
        centroids[n] = spherical_kmeans(_unit(sample.tolist()), max(1, min(MOST, math.ceil(count / PER_CELL))))
    assigned = cut(_assign(points, centroids, threshold))
    # blocks of a cell: blocks of members in the one, of members and visitors in the other; every block of members meets every block of the cell
    shape = assigned.groupBy("cell").agg(F.sum(F.col("member").cast("int")).alias("m"), F.count("*").alias("n"))
    shape = shape.select("cell", F.ceil(F.col("m") / LEFT).alias("mb"), F.ceil(F.col("n") / RIGHT).alias("nb")).where("mb > 0")
    placed = assigned.join(shape, "cell").withColumn("h", F.xxhash64("id"))
    left = placed.where("member").select("cell", F.pmod("h", "mb").alias("lb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("rb"), F.lit(True).alias("left"), "id", "v", "weight")
    right = placed.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)).alias("lb"), F.pmod(F.col("h"), F.col("nb")).alias("rb"), F.lit(False).alias("left"), "id", "v", "weight")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["left"]], group[~group["left"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": [], "other": []}).astype("int64")
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        row, col = _above(_unit(a["v"].tolist()), _unit(b["v"].tolist()), threshold)
        other = ids_a[row] != ids_b[col]
        row, col = row[other], col[other]
        counts = np.bincount(row, b["weight"].to_numpy()[col], len(ids_a)).astype(np.int64)
        all_ids, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
        roots = np.array(local_roots(at[row].tolist(), at[len(ids_a) + col].tolist(), len(all_ids)), np.int64)
        linked = np.flatnonzero(roots != np.arange(len(all_ids)))
        return pd.DataFrame({
            "id": np.concatenate([ids_a[counts > 0], all_ids[linked]]), "n": np.concatenate([counts[counts > 0], np.zeros(len(linked), np.int64)]),
            "other": np.concatenate([ids_a[counts > 0], all_ids[roots[linked]]]),
        })

    found = left.unionByName(right).groupBy("cell", "lb", "rb").applyInPandas(compare, "id long, n long, other long")
    found = cut(found.where("n > 0 or other != id"))
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    groups = components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
    # back from points to rows: a row's links are its point's other points and the point's other rows
    named = groups.withColumnRenamed("node", "id").join(points.select("id", "name"), "id")
    least = named.groupBy("component").agg(F.min("name").alias("least"))
    told = points.join(counts, "id", "left").join(named.select("id", "component"), "id", "left").join(least, "component", "left")
    told = told.select("v", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("component").isNull(), F.col("name")).otherwise(F.col("least")).alias("component"), "weight")
    keyed = df.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    out = keyed.join(told, "v", "left")
    lone = F.col("weight").isNull()
    component = F.when(lone, F.col("k")).otherwise(F.col("component"))
    return out.select(
        F.col("k").alias(key), F.when(lone, 0).otherwise(F.col("links") + F.col("weight") - 1).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"),
    )
