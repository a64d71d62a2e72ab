"""Packing documents into training windows by multiway differencing.

Each task codes its documents and cuts them into pieces. Whole windows of a document
are windows of their own. What is left of each document is dealt, in reading order, to
batches of a fixed number of windows; the piece at a batch's end is cut so that batches
are full. Inside a batch the Karmarkar-Karp differencing method divides the pieces
among the windows: every partial division is a vector of window sums, the two with the
largest spreads are merged with opposing order, and so on until one is left. If a
window then exceeds its capacity, the batch is divided again among one window more.

A batch is bounded (``BATCH`` windows) and belongs to one task, so no shuffle is needed
and nothing grows with the input but the number of tasks. Sequence ids are made from
the partition's number and a count in it.

Defined results: a null or empty text is the single id 0 at a document's end; long
texts become as many windows as they need; repeated rows are packed as often as they
occur; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.llm.chunks import rank_coder

CAPACITY = 1024
#: Windows of a batch, the longest piece that takes part in the differencing, and the room left in each window of a batch.
BATCH, LONGEST, ROOM = 48, 256, 7
#: The last ids of a batch are cut to small pieces, which even out what the large ones leave.
EVEN, SMALL = 2048, 12

#: Texts that are coded before their pieces are handed on.
TEXTS = 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Divides items among windows by multiway differencing; gives each window's items."""
    heap: list[tuple[int, int, np.ndarray, list[list[int]]]] = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [[i], *[[]] * (windows - 1)]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, parts_a = heapq.heappop(heap)
        _, _, b, parts_b = heapq.heappop(heap)
        sums = a + b[::-1]  # both fall, so that the largest meets the smallest
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        parts = [parts_a[k] + parts_b[windows - 1 - k] for k in order.tolist()]
        heapq.heappush(heap, (-int(sums[0]), count, sums, parts))
        count += 1
    return heap[0][3] if heap else [[] for _ in range(windows)]


def divide(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few windows as the differencing method needs; their number rises while any exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        made = difference(sizes, windows)
        if all(sum(sizes[i] for i in part) <= capacity for part in made):
            return [part for part in made if part]
        windows += 1


class _Packer:
    def __init__(self, first: int):
        self.sequence = first
        self.pieces: list[tuple[int, int, np.ndarray, int]] = []
        self.total = 0

    def _row(self, piece: tuple[int, int, np.ndarray, int], offset: int) -> tuple:
        doc, start, ids, tokens = piece
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.sequence, offset

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple]:
        start, tokens = 0, len(ids)
        while tokens - start >= CAPACITY:
            yield self._row((doc, start, ids[start : start + CAPACITY], tokens), 0)
            self.sequence += 1
            start += CAPACITY
        full = BATCH * (CAPACITY - ROOM)
        while start < tokens:
            left = full - self.total
            size = min(LONGEST if left > EVEN else SMALL, tokens - start, left)
            self.pieces.append((doc, start, ids[start : start + size].copy(), tokens))
            self.total += size
            start += size
            if self.total == full:
                yield from self.close()

    def close(self) -> Iterator[tuple]:
        for part in divide([len(p[2]) for p in self.pieces]) if self.pieces else []:
            # the pieces of one document that meet in a window lie in order, and those that touch become one
            offset, joined = 0, []
            for piece in (self.pieces[i] for i in sorted(part)):
                if joined and joined[-1][0] == piece[0] and joined[-1][3] == piece[3] and joined[-1][1] + len(joined[-1][2]) == piece[1]:
                    doc, start, ids, tokens = joined[-1]
                    joined[-1] = (doc, start, np.concatenate([ids, piece[2]]), tokens)
                else:
                    joined.append(piece)
            for piece in joined:
                yield self._row(piece, offset)
                offset += len(piece[2])
            self.sequence += 1
        self.pieces, self.total = [], 0


@lru_cache(maxsize=2)
def _coder(ranks: str, pattern: str) -> Callable[[str], list[int]]:
    return rank_coder(ranks, pattern)


def pack(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all texts in windows of 1024 ids at most. ``ranks``: path of the vocabulary, on every machine."""
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = _coder(ranks, pattern), _Packer(TaskContext.get().partitionId() << 40)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    rows.extend(packer.add(doc, np.array([*code(text or ""), 0], np.uint32)))
                if rows:
                    yield out(rows)
        if rows := list(packer.close()):
            yield out(rows)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECE)

