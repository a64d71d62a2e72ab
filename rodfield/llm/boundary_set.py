"""A compressed set of the places in a text where a unit ends and the next begins.

Places (byte offsets) are kept by blocks of 65,536: as a sorted array where they are few, as
a bitmap where they are many, as runs where they follow each other, whichever is least. The
cardinalities of the blocks are summed up, so the k-th place is found by a search for its
block and a selection inside it, without a list of all places.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 1 << 16
#: Most places of an array, and bytes of a bitmap.
FEW, BITMAP_BYTES = 4096, BLOCK // 8


class Container(NamedTuple):
    """One block's places: ``kind``, the places (array), 64-bit words (bitmap) or first places (runs), and for bitmaps and runs
    the number of places before each word or run."""

    kind: str
    values: np.ndarray
    before: np.ndarray | None


def container(mask: np.ndarray) -> Container:
    """The least container of the places that a mask of up to 65,536 marks."""
    count = int(np.count_nonzero(mask))
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0)) == 1)
    if 4 * len(edges) < min(2 * count if count <= FEW else BITMAP_BYTES, BITMAP_BYTES):
        ends = np.flatnonzero(np.diff(mask.view(np.int8), append=np.int8(0)) == -1)
        return Container("run", edges.astype(np.uint16), np.cumsum(ends - edges + 1) - (ends - edges + 1))
    if count <= FEW:
        return Container("array", np.flatnonzero(mask).astype(np.uint16), None)
    bits = np.zeros(BLOCK, np.bool_)
    bits[: len(mask)] = mask
    words = np.packbits(bits, bitorder="little").view("<u8")
    held = np.bitwise_count(words).astype(np.int64)
    return Container("bitmap", words, np.cumsum(held) - held)


def select(found: Container, k: int) -> int:
    """The k-th place (from 0) of a container."""
    if found.kind == "array":
        return int(found.values[k])
    at = int(np.searchsorted(found.before, k, "right")) - 1
    left = k - int(found.before[at])
    if found.kind == "run":
        return int(found.values[at]) + left
    bits = np.unpackbits(found.values[at : at + 1].view(np.uint8), bitorder="little")
    return at * 64 + int(np.flatnonzero(bits)[left])


class BoundarySet:
    """The set of marked places. ``mask``: one boolean for each byte offset, the last one for the text's end."""

    def __init__(self, mask: np.ndarray):
        blocks = [mask[at : at + BLOCK] for at in range(0, len(mask), BLOCK)]
        counts = [int(np.count_nonzero(b)) for b in blocks]
        self.keys = np.array([i for i, c in enumerate(counts) if c], np.int64)
        self.containers = [container(blocks[i]) for i in self.keys]
        #: Places up to and with each container.
        self.total = np.cumsum([counts[i] for i in self.keys], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.total[-1]) if len(self.total) else 0

    def select(self, k: int) -> int:
        """The k-th place of all, from 0."""
        at = int(np.searchsorted(self.total, k, "right"))
        before = int(self.total[at - 1]) if at else 0
        return int(self.keys[at]) * BLOCK + select(self.containers[at], k - before)


def code_point_bounds(data: bytes) -> BoundarySet:
    """Where code points of a UTF-8 text begin, and its end. The first byte begins one in any case."""
    mask = np.ones(len(data) + 1, np.bool_)
    if data:
        mask[1:-1] = (np.frombuffer(data, np.uint8)[1:] & 0xC0) != 0x80
    return BoundarySet(mask)
