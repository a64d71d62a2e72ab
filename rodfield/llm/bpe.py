"""Byte-level BPE encoding and decoding in numpy.

Distinct pieces of text are laid out as padded matrices, one for each range of lengths.
In every round each row looks up the ranks of its neighbouring pairs in a hashed table
of pairs, merges the leftmost pair of least rank and is compacted by one place; rows
without a mergeable pair leave the matrix. Pieces longer than the longest matrix merge in
the same order from a heap of their pairs. Decoding gathers the bytes of all ids at once.

Tasks work on their own rows only; nothing is shuffled. Memory per task is bounded by a
slice of some millions of bytes, or by one text where that is longer.

Defined results: a null text is empty; an empty text has no ids; text that is one
unbroken run of any length is one piece, in time that grows as its length (and the
heap's logarithm); repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.llm.chunks import ChunkCoder, read_ranks

_NONE = np.int64(1 << 40)
#: Longest piece of each matrix, and most cells of a matrix; pieces above the last length are merged from a heap.
LENGTHS, CELLS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 512), 400_000


class PairTable:
    """Ranks of pairs of ids, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.mask = np.int64(size - 1)
        self.keys, self.ranks = np.full(size, np.uint64(2**64 - 1)), np.full(size, _NONE)
        self.probes, todo, step = 0, np.arange(len(keys)), 0
        while len(todo):
            at = (self._home(keys[todo]) + step) & self.mask
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.ranks[at[won]] = keys[todo[won]], np.array(rank, np.int64)[todo[won]]
            todo, step = np.delete(todo, won), step + 1
        self.probes = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        home = self._home(keys)
        found = np.where(self.keys[home] == keys, self.ranks[home], _NONE)
        open_ = np.flatnonzero((self.keys[home] != keys) & (self.keys[home] != np.uint64(2**64 - 1)))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (home.flat[open_] + step) & self.mask
            held = self.keys[at]
            hit = held == keys.flat[open_]
            found.flat[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
        return found


class BytePairCoder:
    """Codes and decodes by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pairs, self.cut = ranks, PairTable(ranks), regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        size = max(ranks.values()) + 1
        by = [b""] * size
        for token, r in ranks.items():
            by[r] = token
        self.bytes, self.sizes = np.frombuffer(b"".join(by), np.uint8), np.array([len(t) for t in by], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def merge(self, pieces: Sequence[bytes]) -> list[list[int]]:
        """Ids of pieces that are not tokens themselves."""
        out: list[list[int]] = [[] for _ in pieces]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for high in LENGTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(rows, max(1, -(-len(rows) * high // CELLS))):
                if len(part):
                    self._matrix([pieces[i] for i in part], part, out)
            low = high
        for i in np.flatnonzero(sizes > low).tolist():
            out[i] = self._long(pieces[i])
        return out

    def _long(self, piece: bytes) -> list[int]:
        """Ids of one long piece: the leftmost pair of least rank is on top of a heap, and ids are linked to their neighbours."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        at = np.flatnonzero(ranks < _NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        values, n = ids.tolist(), len(ids)
        begin, end = list(range(n)), list(range(1, n + 1))  # of each id, where its bytes begin and end
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = bytearray(b"\1") * n
        get = self.ranks.get
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or get(piece[begin[i] : end[j]]) != rank:
                continue  # one of the pair has been merged since
            values[i], end[i], after[i], live[j] = rank, end[j], after[j], 0
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get(piece[begin[k] : end[after[k]]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [v for v, alive in zip(values, live, strict=True) if alive]

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, out: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        flat = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.zeros((len(pieces), width), np.int64)
        here = np.arange(width) < sizes[:, None]
        ids[here] = flat
        ranks = np.full((len(pieces), width), _NONE)
        both = here[:, 1:]
        ranks[:, :-1][both] = self.pairs(ids[:, :-1][both], ids[:, 1:][both])
        while len(rows):
            at = ranks.argmin(1)
            n = np.arange(len(rows))
            best = ranks[n, at]
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[rows[i]] = ids[i, : sizes[i]].tolist()
                keep = ~done
                rows, ids, ranks, sizes, at, best = rows[keep], ids[keep], ranks[keep], sizes[keep], at[keep], best[keep]
                if not len(rows):
                    return
                n = np.arange(len(rows))
            # compaction: the right half of each merged pair goes, and with it the rank to its right
            ids[n, at] = best
            stay = np.ones(ids.shape, bool)
            stay[n, at + 1] = False
            width = ids.shape[1] - 1
            ids, ranks = ids[stay].reshape(-1, width), ranks[stay].reshape(-1, width)
            sizes = sizes - 1
            for side in (at - 1, at):
                ok = (side >= 0) & (side + 1 < sizes)
                r, c = n[ok], side[ok]
                ranks[r, c] = self.pairs(ids[r, c], ids[r, c + 1])
                bad = (side >= 0) & (side + 1 >= sizes)
                ranks[n[bad], side[bad]] = _NONE

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, each match of the pattern by itself."""
        cut = [[p.encode() for p in self.cut(t)] for t in texts]
        new = [p for p in dict.fromkeys(p for ps in cut for p in ps) if p not in self.ranks]
        made = dict(zip(new, self.merge(new), strict=True))
        get = self.ranks.get
        out = []
        for pieces in cut:
            ids: list[int] = []
            for p in pieces:
                if (one := get(p)) is not None:
                    ids.append(one)
                else:
                    ids += made[p]
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids in a row."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


@lru_cache(maxsize=2)
def _coders(ranks: str, pattern: str) -> tuple[BytePairCoder, ChunkCoder]:
    coder = BytePairCoder(read_ranks(ranks), pattern)
    return coder, ChunkCoder(coder.encode)


def round_trip(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids, and gives both: ``ids`` and ``decoded`` beside the key."""
    return _apply(df, ranks, pattern, key, text, "ids array<long>, decoded binary", lambda ids, raw: ([i for i in ids.tolist()], raw))


def digest(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`round_trip`, with the ids' number and hash and the decoded bytes' hash in place of both."""
    made = lambda ids, raw: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
    return _apply(df, ranks, pattern, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", made)


def _apply(df: DataFrame, ranks: str, pattern: str, key: str, text: str, schema: str, row) -> DataFrame:
    given = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, chunks = _coders(ranks, pattern)
        for batch in batches:
            for first, ids, begin in chunks.encode_column(batch.column(1)):
                rows = []
                raw, ends = coder.decode(ids), np.concatenate([[0], np.cumsum(coder.sizes[ids])])
                for i in range(len(begin) - 1):
                    rows.append(row(ids[begin[i] : begin[i + 1]], raw[ends[begin[i]] : ends[begin[i + 1]]]))
                made = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *made], ["doc_id", *[n for n, _ in fields]])

    return given.mapInArrow(run, f"doc_id long, {schema}")
