"""Tokenizing long texts by way of their distinct chunks.

A chunk is a run of bytes from a space up to the next. The pattern that splits texts
before byte-level merges never matches across the place before a lone space, so the
ids of a text are those of its chunks in a row. Texts repeat their chunks: a worker
codes each distinct chunk once, knows it by its bytes, and puts ids together with
numpy. What is kept of distinct chunks is bounded in bytes and emptied beyond
``LIMIT``. Texts with a space beside other white space are coded as a whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of distinct chunks (each with ENTRY for its place in the table) that a worker keeps, and bytes of texts at a time.
LIMIT, ENTRY, SLICE = 96_000_000, 160, 2_000_000
#: Marks the first chunk of a text, which has no space before it; other chunks of texts cut here never begin with it.
FIRST = b"\n"

#: White space of the pattern, as UTF-8 (fixed values): single bytes, and the longer ones.
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _wide(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes are, or begin with, white space beyond ASCII."""
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    return two | three | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))


def _beside(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the spaces at these places have white space beside them (or may have, at the ends of texts)."""
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])
    p = at + 3
    after, before = padded[p + 1], padded[p - 1]
    found = _SPACES[after] | _SPACES[before]
    found |= _wide(after, padded[p + 2], padded[p + 3]) & (after >= 0xC2)
    return found | _wide(padded[p - 3], padded[p - 2], before) | _wide(padded[p - 2], before, before) & (padded[p - 2] == 0xC2)


class ChunkTable:
    """Numbers the distinct chunks that a worker meets."""

    limit = LIMIT

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held = 0

    def learn(self, chunks: list[bytes]) -> None:
        """Called with chunks that get the next numbers."""
        raise NotImplementedError

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of the chunks. They hold until the next call."""
        if self.held > self.limit:
            self.clear()
        found = list(map(self.at.get, chunks))
        if None in found:
            missing = [i for i, n in enumerate(found) if n is None]
            new = list({chunks[i] for i in missing})
            self.learn(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.held += sum(map(len, new)) + ENTRY * len(new)
            for i in missing:
                found[i] = self.at[chunks[i]]
        return np.array(found, np.int64)


def ranges(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """An Arrow column of texts (null as empty) in ranges of some millions of bytes: the first row, the bytes, and where
    each row's begin (and the last end)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


class ChunkCoder(ChunkTable):
    """Texts to ids, given a function that codes a list of distinct strings."""

    def __init__(self, code: Callable[[list[str]], Sequence[Sequence[int]]]):
        self.code = code
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.flat, self.starts = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def learn(self, chunks: list[bytes]) -> None:
        coded = self.code([(c[1:] if c[:1] == FIRST else b" " + c).decode("utf-8", "replace") for c in chunks])
        first = len(self.at)
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        total, used = int(counts.sum()), int(self.starts[first])
        while len(self.starts) <= first + len(chunks):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(self.flat) < used + total:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.starts[first + 1 : first + 1 + len(chunks)] = used + np.cumsum(counts)
        self.flat[used : used + total] = np.fromiter(chain.from_iterable(coded), np.uint32, total)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another in UTF-8, and where each text's ids begin (and the last end)."""
        spaces = np.flatnonzero(data == 32)
        whole = np.zeros(len(offsets) - 1, bool)
        if len(spaces):
            whole[np.searchsorted(offsets, spaces[_beside(data, spaces)], side="right") - 1] = True
        raw, chunks, ends = data.tobytes(), [], [0]
        for a, b, w in zip(offsets[:-1].tolist(), offsets[1:].tolist(), whole.tolist(), strict=True):
            if a < b and not w:
                parts = raw[a:b].split(b" ")
                parts[0] = FIRST + parts[0]
                chunks += parts
            ends.append(len(chunks))
        at = self.numbers(chunks)
        begins = self.starts[at]
        counts = self.starts[at + 1] - begins
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(begins - upto[:-1], counts) + np.arange(int(upto[-1]))]
        out = upto[ends]
        if not whole.any():
            return ids, out
        rows = np.flatnonzero(whole)
        coded = [np.asarray(x, np.uint32) for x in self.code([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in rows])]
        pieces, sizes = np.split(ids, out[1:-1]), np.diff(out)
        for i, x in zip(rows, coded, strict=True):
            pieces[i], sizes[i] = x, len(x)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For an Arrow column of texts (null as empty), in ranges of some millions of bytes: the first row, the ids, and
        where each row's begin."""
        for row, data, offsets in ranges(column):
            yield row, *self.encode_bytes(data, offsets)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_coder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Codes a text by a rank file. For the same vocabulary this gives the ids of the tokenizers library, whose file
    format holds merges instead of ranks (a test compares both), at a fifth of its time."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
