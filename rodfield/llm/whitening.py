"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers (``scale`` times an entry, rounded down, plus ``shift``). The fit is over each distinct
vector once. With X the centred fit vectors as rows, the method builds orthonormal v's and u's, X V = U B and X'U = V B' + r, with B
bidiagonal: in each step the distributed products X v and X'u are taken, and both are orthogonalised against all before. The SVD of
the small B gives the components (V times its right vectors) and their deviations (its singular values by the root of n).

Vectors as long as there are rows are never stored: u_k = X w_k, and the w's, of the length of one row, are kept instead. One pass over
the blocks of X a step gives |Xt|^2, the products of Xt with all u's, and X'Xt, for t = v - b w; all that leaves a task is
these sums. What a task holds is a block of rows and the v's and w's. If the products show that orthogonality was
lost, the pass is repeated with what is left. Where a step leads to nothing (equal deviations, or fewer directions than
entries) the next v is any direction orthogonal to those before.

Vectors of up to ``COMPLETE`` entries are bidiagonalised completely; for longer ones the steps end when the leading components' residuals are
below 1e-14 of the largest deviation (components whose deviations agree in all digits may then count once).

Centring is exact: n x - S in integers, over n. Sums of integers are exact.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries give no rows; vectors of different lengths are
whitened each length by itself; entries beyond 2^40 in size count as 2^40; components whose variance is below 1e-20 of the largest are left out,
so a single vector, or equal ones, give no rows; a ``deviation`` beyond a long is null; rows with equal keys give results each; null
keys stay null; columns besides key and vector are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.llm._common import cut

#: Rows of a block, and entries of a vector up to which the bidiagonalisation is completed.
ROWS, COMPLETE = 2048, 512
#: Bytes of vectors of a task, and most tasks whose sums go to the driver as they are (else Spark adds them up first).
TASK_BYTES, DIRECT = 1 << 27, 1024
#: Relative size of nothing, of a residual that counts as none, and of a component's deviation that is left out.
NOTHING, SETTLED, SMALL = 1e-12, 1e-14, 1e-10
LARGEST = float(1 << 40)


class Whitening(NamedTuple):
    """A fit: distinct vectors, their sums, unit components as rows, variances, the trace of the covariance, and what the whitened fit
    vectors' covariance misses of the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    error: float


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """``id`` and ``x``, the vector as integers, of all rows whose vector can be used."""
    held = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col("c").isNotNull() & (F.size("c") > 0) & ~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(key).alias("id"), held.alias("c")).where(good)
    near = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.select("id", F.transform("c", lambda c: F.floor(near(c) * scale).cast("long") + shift).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def packed(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, in blocks of vectors of one length: their bytes (in 32 bits where that holds them), ``rows`` and ``size``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def out(size: int) -> pa.RecordBatch:
            x = np.concatenate(held.pop(size))
            x = x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([len(x)], pa.int64()), pa.array([size], pa.int32())], ["block", "rows", "size"])

        for batch in batches:
            sizes = np.asarray(batch.column(1))
            for size in np.unique(sizes).tolist():
                x = _matrix(batch.filter(pa.array(sizes == size)).column(0), size)
                for at in range(0, len(x), ROWS):
                    held.setdefault(size, []).append(x[at : at + ROWS])
                    if sum(map(len, held[size])) >= ROWS:
                        yield out(size)
        for size in list(held):
            yield out(size)

    return rows.select("x").distinct().select("x", F.size("x").alias("size")).mapInArrow(run, "block binary, rows long, size int")


def _read(block: pa.Scalar, rows: int, size: int) -> np.ndarray:
    data = block.as_buffer()
    return np.frombuffer(data, np.int32 if data.size == 4 * rows * size else np.int64).reshape(rows, size).astype(np.int64)


def sums_of(blocks: DataFrame, size: int) -> list[int]:
    """The exact sum of each entry over all vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int64()), pa.array(_read(block, rows.as_py(), size).sum(0), pa.int64())], ["at", "v"])

    found = blocks.select("block", "rows").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return [int(r["v"]) for r in found.orderBy("at").collect()]


class Centred(NamedTuple):
    """The fit vectors of one length, less their mean, as the rows of a matrix that stays in blocks."""

    blocks: DataFrame
    tasks: int
    n: int
    sums: list[int]

    def total(self, run: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
        """The sum over all blocks of what ``run`` gives for one, an array of ``length`` numbers; each task adds up its own first."""
        n, sums = self.n, self.sums

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for block, rows in zip(batch.column(0), batch.column(1), strict=True):
                    part = run(centred(_read(block, rows.as_py(), len(sums)), n, sums))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.float64())], ["at", "v"])

        found = np.zeros(length)
        rows = self.blocks.mapInArrow(add, "at long, v double")
        if self.tasks > DIRECT:
            rows = rows.groupBy("at").agg(F.sum("v").alias("v"))
        for r in rows.collect():
            found[r["at"]] += r["v"]
        return found

    def products(self, t: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """|Xt|^2, (Xw)'Xt and X'Xt."""
        k = len(w)

        def run(x: np.ndarray) -> np.ndarray:
            p = x @ t
            return np.concatenate([[p @ p], (x @ w.T).T @ p, p @ x])

        found = self.total(run, 1 + k + len(t))
        return float(found[0]), found[1 : k + 1], found[k + 1 :]


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: in 64 bits where that holds them, else as Python's integers."""
    middle = np.array([round(s / n) for s in sums], np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    near = x - middle
    if max(int(np.abs(near).max(initial=0)) * n, *map(abs, rest)) < 1 << 61:
        return near * n - np.array(rest, np.int64)
    return near.astype(object) * n - np.array(rest, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, each entry to double precision."""
    return (offsets(x, n, sums) / n).astype(np.float64)


def squares(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over entries of (n x - S)^2, exactly; None beyond a long."""
    d = offsets(x, n, sums)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 62:
        return (d * d).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


class _Basis:
    """Orthonormal vectors of one row's length, and new ones orthogonal to them."""

    def __init__(self, size: int):
        self.v = np.empty((0, size))
        self.random = np.random.default_rng(12)

    def clear(self, t: np.ndarray) -> np.ndarray:
        for _ in range(2):
            t = t - self.v.T @ (self.v @ t)
        return t

    def other(self) -> np.ndarray:
        """A unit vector orthogonal to all."""
        while True:
            t = self.clear(self.random.standard_normal(self.v.shape[1]))
            if np.linalg.norm(t) > 1e-6:
                return self.clear(t / np.linalg.norm(t)) / np.linalg.norm(self.clear(t / np.linalg.norm(t)))

    def put(self, t: np.ndarray) -> None:
        self.v = np.vstack([self.v, t])


def bidiagonalise(x: Centred, components: int, complete: int = COMPLETE) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of X as rows, and their singular values."""
    size = len(x.sums)
    basis = _Basis(size)
    w, z = np.empty((0, size)), np.empty((0, size))  # u_k = X w_k, z_k = X'u_k
    alphas: list[float] = []
    betas: list[float] = []
    top, beta, v = 0.0, 0.0, basis.other()
    while True:
        basis.put(v)
        t = v - beta * w[-1] if len(w) else v
        for _ in range(3):
            s, h, g = x.products(t, w)
            if s == 0 or h @ h < 0.5 * s:
                break
            t = t - w.T @ h
        alpha = float(np.sqrt(max(s - h @ h, 0.0)))
        top = max(top, alpha, beta)
        if alpha > NOTHING * top:
            w, z = np.vstack([w, (t - w.T @ h) / alpha]), np.vstack([z, (g - z.T @ h) / alpha])
        else:
            alpha, w, z = 0.0, np.vstack([w, np.zeros(size)]), np.vstack([z, np.zeros(size)])
        alphas.append(alpha)
        r = basis.clear(z[-1] - alpha * v)
        beta = float(np.linalg.norm(r))
        if len(alphas) == size or size > complete and len(alphas) >= components and len(alphas) % 8 == 0:
            p, values, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if len(alphas) == size or (beta * np.abs(p[-1, :components])).max() <= SETTLED * values[0]:
                return q[:components] @ basis.v, values[:components]
        if beta > NOTHING * top:
            v = r / beta
        else:
            v, beta = basis.other(), 0.0
        betas.append(beta)


def fit(rows: DataFrame, components: int = 16, complete: int = COMPLETE) -> dict[int, Whitening]:
    """For each length of vectors its whitening. ``rows``: of :func:`integers`."""
    blocks = cut(packed(rows))
    found = {}
    for size, n in sorted((r["size"], r["n"]) for r in blocks.groupBy("size").agg(F.sum("rows").alias("n")).collect()):
        mine = blocks.where(F.col("size") == size)
        # a pass is many small products: no more tasks than there are cores, or than the bytes ask for
        tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, math.ceil(8 * n * size / TASK_BYTES))
        x = Centred(mine.select("block", "rows").coalesce(tasks), tasks, n, sums_of(mine, size))
        vectors, values = bidiagonalise(x, components, complete)
        some = values > SMALL * values[0]
        vectors, variances = vectors[some], values[some] ** 2 / n
        by = (vectors / np.sqrt(variances)[:, None]).T
        k = len(vectors)

        def check(block: np.ndarray, by: np.ndarray = by) -> np.ndarray:
            y = block @ by
            return np.concatenate([[(block * block).sum()], (y.T @ y).ravel()])

        sums = x.total(check, 1 + k * k) / n
        error = float(np.abs(sums[1:].reshape(k, k) - np.eye(k)).max()) if k else 0.0
        found[size] = Whitening(n, x.sums, vectors, variances, float(sums[0]), error)
    return found


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000, complete: int = COMPLETE) -> DataFrame:
    """For each row and component: the key, ``component`` (from 1), ``n``, ``deviation`` (the sum of (n x - S)^2), ``whitened`` (along
    the component, by its deviation), ``explained`` (the component's share of the variance) and ``identity_error``."""
    rows = integers(df, key, vector, scale, shift)
    models = df.sparkSession.sparkContext.broadcast(fit(rows, components, complete))
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            for size in np.unique(sizes):
                m = models.value[int(size)]
                mine = batch.filter(pa.array(sizes == size))
                x = _matrix(mine.column(1), int(size))
                k = len(m.components)
                y = centred(x, m.n, m.sums) @ (m.components / np.sqrt(m.variances)[:, None]).T
                ids = mine.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                deviation = pa.array(squares(x, m.n, m.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                every = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), pa.int32()), pa.array(np.full(every, m.n), pa.int64()), deviation,
                    pa.array(y.ravel(), pa.float64()), pa.array(np.tile(m.variances / m.trace if k else m.variances, len(x)), pa.float64()), pa.array(np.full(every, m.error), pa.float64()),
                ], names)

    return rows.select("id", "x", F.size("x").alias("size")).mapInArrow(run, schema)
