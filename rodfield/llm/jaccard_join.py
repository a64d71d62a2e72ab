"""N-gram Jaccard join by chosen paths.

A text's set is its distinct runs of five words. Equal sets are one node with a weight.
A node is embedded as 64 minhash tokens. In each run a node follows the tokens that a
hash of run, path and token selects, ``FANOUT`` of 64 on average, so that similar sets
meet in a bucket with a probability that is high where they share many tokens. Buckets
with one node end. Buckets of at most ``SMALL`` nodes are leaves. Runs are repeated until
the recall at the threshold reaches the target: a pair survives a run with probability
s = 1 - exp(-FANOUT * threshold * s).

Larger buckets are split again along tokens selected by the path so far, but for groups
that splitting would only multiply. A bucket's centre is the most frequent token of each
place. Nodes that agree with it in ``CORE`` places or more are the core: it is compared
with itself and with the rim, the nodes that are near enough to the centre to be similar
to a node of the core (places where two nodes differ obey the triangle inequality). Core
nodes need no further split; all others go on. Cores that share most of their nodes are
compared once. Where a level makes the large buckets hardly smaller, the core is widened,
down to the whole bucket, so that the recursion ends by itself, whatever the data.

In a leaf, pairs are first judged by their tokens; nodes with a likely partner there go
on with their whole sets, and the similarity of pairs is then exact. A pair that meets
in several leaves counts only in the least of them, which both nodes' lists of leaves
tell; so links are counted without ever being written as pairs, and leave a leaf as
counts and as a spanning forest. Leaves are compared in blocks, bounded in rows and in
items of sets.

Defined results: null and empty texts have no words and no links; a text of one to four
words has one run, all of it; words are separated by ASCII white space and compared as
they are (by 64 bits of xxh3; sets by 128 bits); repeated rows are copies of each other;
null ids take part, but are never the id of a group that has another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.llm._common import cut, partitions
from rodfield.llm.chunks import ranges
from rodfield.llm.components import components, local_roots

THRESHOLD, WORDS, TARGET = 0.8, 5, 0.9999
TOKENS, FANOUT, SMALL = 64, 2.5, 512
#: Buckets up to this size whose rows agree with the centre in so many places on average are leaves: a split would shrink them
#: little, and all their pairs are a bounded step.
WHOLE, ALIKE = 4096, 12
#: Places that a core node shares with the centre, places that a similar pair differs in (three deviations), and the share of
#: a bucket that a token of the centre has at least.
CORE, APART, SHARE = 32, 22, 0.1
#: Rows and items of sets of a block, pairs that are judged at a time, and salts of the buckets while tokens are counted.
BLOCK, ITEMS, STEP, SALTS = 1024, 400_000, 200_000, 8
#: Most bits of the table that tells which texts are read again (16 MB); above, it only lets more of them pass.
BITS = 1 << 27
#: Distinct words that a worker remembers.
KNOWN = 200_000

_ODD = np.random.default_rng(5).integers(1, 2**63, size=TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(6).integers(1, 2**63, size=TOKENS, dtype=np.uint64)
_ROWS = np.random.default_rng(7).integers(1, 2**63, size=4096, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_for(target: float = TARGET, threshold: float = THRESHOLD) -> int:
    """Runs until a pair at the threshold is met with the target probability."""
    s = 1.0
    for _ in range(200):
        s = 1 - math.exp(-FANOUT * threshold * s)
    return math.ceil(math.log(1 - target) / math.log(1 - s))


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
_POWERS = np.array([2862933555777941757**k % 2**64 for k in range(WORDS)], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For texts that lie one after another in UTF-8: the sorted distinct hashes of their runs of words."""
    raw, at = data.tobytes(), offsets.tolist()
    cut_ = [raw[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]
    counts = list(map(len, cut_))
    if len(_words) > KNOWN:
        _words.clear()
    word = np.fromiter(map(_words.__getitem__, chain.from_iterable(cut_)), np.uint64, sum(counts))
    del cut_
    none = runs = np.empty(0, np.uint64)
    if len(word) >= WORDS:
        runs = _mix(sum(word[k : len(word) - WORDS + 1 + k] * _POWERS[k] for k in range(WORDS)))
    out, stop = [], 0
    for count in counts:
        stop += count
        if count >= WORDS:
            out.append(np.unique(runs[stop - count : stop - WORDS + 1]))
        elif count:
            out.append(_mix(np.array([(word[stop - count : stop] * _POWERS[:count]).sum() + np.uint64(count)], np.uint64)))
        else:
            out.append(none)
    return out


def _tokens(found: np.ndarray) -> np.ndarray:
    """Minhash tokens of a set."""
    low = np.full(TOKENS, np.uint64(2**64 - 1))
    for start in range(0, len(found), 4096):
        part = found[start : start + 4096]
        low = np.minimum(low, (part[:, None] * _ODD + _ADD).min(0))
    return (_mix(low) >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in ranges(batch.column(1)):
            found = shingles(data, offsets)
            node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            tokens = [_tokens(s).tobytes() if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), pa.array(node, pa.binary()), pa.array(map(len, found), pa.int32()), pa.array(tokens, pa.binary())], ["id", "node", "n", "tokens"])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of equal length as rows."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.empty((0, 1), kind)


def _follow(nodes: pa.Array, tokens: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and new paths: of each row, the tokens that its seed selects."""
    where = np.arange(TOKENS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = _mix(_mix(tokens.astype(np.uint64) + where) ^ seeds[:, None])
    row, col = np.nonzero(h < np.uint64(int(FANOUT / TOKENS * 2**64)))
    return row, _mix(h[row, col] + np.uint64(1)).view(np.int64)


def _first(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                tokens = _matrix(part.column(1), np.uint32)
                for k in range(runs):
                    row, path = _follow(part.column(0), tokens, np.full(len(tokens), _mix(np.array([k + 1], np.uint64))[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(path), part.column(0).take(pa.array(row))], ["path", "node"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            row, path = _follow(part.column(1), _matrix(part.column(2), np.uint32), _mix(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(path), part.column(1).take(pa.array(row))], ["path", "node"])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each place that are frequent among a bucket's rows here, counted within some thousands of rows."""
    names = ["path", "place", "token", "f"]
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            path, bucket, rows = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            slot = bucket.astype(np.uint64)[:, None] * np.uint64(TOKENS) + np.arange(TOKENS, dtype=np.uint64)
            keys, counts = np.unique(slot << np.uint64(32) | _matrix(part.column(1), np.uint32), return_counts=True)
            bucket, place = np.divmod((keys >> np.uint64(32)).astype(np.int64), TOKENS)
            keep = (counts >= 2) & (counts >= SHARE / 2 * rows[bucket])
            token = (keys & np.uint64(2**32 - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(path[bucket[keep]]), pa.array(place[keep].astype(np.int32)), pa.array(token[keep]), pa.array(counts[keep])], names)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many places a row has its bucket's centre."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            tokens, centre = _matrix(part.column(3), np.uint32).astype(np.int64), part.column(4)
            sizes = np.diff(centre.offsets.to_numpy())
            flat = centre.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            same = tokens[row, flat.field("place").to_numpy()] == flat.field("token").to_numpy()
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(np.bincount(row[same], minlength=len(sizes)).astype(np.int32))], ["path", "node", "size", "agree"])


def _with_sizes(rows: DataFrame) -> DataFrame:
    """Rows of buckets of two nodes or more, with the bucket's size."""
    sizes = rows.groupBy(F.col("path").alias("__path")).agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, F.col("path") == F.col("__path")).drop("__path")


def _judged(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of large buckets and in how many places each agrees with its bucket's centre."""
    seen = large.join(nodes.select("node", "tokens"), "node").select("path", "node", "size", "tokens")
    dealt = seen.repartition(max(partitions(nodes), 8), "path", F.pmod(F.xxhash64("node"), F.lit(SALTS))).sortWithinPartitions("path")
    often = dealt.select("path", "tokens").mapInArrow(_often, "path long, place int, token long, f long").groupBy("path", "place", "token").agg(F.sum("f").alias("f"))
    modes = often.groupBy("path", "place").agg(F.max_by("token", F.struct("f", "token")).alias("token"), F.max("f").alias("f"))
    sizes = large.select("path", "size").distinct()
    centres = modes.join(sizes, "path").where(F.col("f") >= SHARE * F.col("size")).groupBy(F.col("path").alias("__path")).agg(F.collect_list(F.struct("place", "token")).alias("centre"))
    none = F.array().cast("array<struct<place:int,token:bigint>>")
    met = seen.join(centres, F.col("path") == F.col("__path"), "left").select("path", "node", "size", "tokens", F.coalesce("centre", none).alias("centre"))
    return met.mapInArrow(_agree, "path long, node binary, size long, agree int")


def _merged(rows: DataFrame) -> DataFrame:
    """Groups of a core and its rim that share most of the core become one: each goes to the least group that most of its
    core nodes are in. Pairs that meet still do, and a large group of near copies, which all runs find, is compared once."""
    core = rows.where("core").select("path", "node")
    least = core.groupBy("node").agg(F.min("path").alias("least"))
    votes = core.join(least, "node").groupBy(F.col("path").alias("__path"), "least").agg(F.count("*").alias("votes"))
    into = votes.groupBy("__path").agg(F.max_by("least", F.struct("votes", -F.col("least"))).alias("__into"))
    moved = rows.join(into, F.col("path") == F.col("__path")).groupBy(F.col("__into").alias("path"), "node").agg(F.max("core").alias("core"))
    return moved.select("path", "node", "core")


def leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """Rows (path, node, core) of all leaves of all runs; rows outside the core are compared with the core only."""
    live = cut(_with_sizes(nodes.select("node", "tokens").mapInArrow(_first(runs), "path long, node binary")))
    small, groups, core, before = [], [], CORE, None
    while True:
        small.append(live.where(F.col("size") <= SMALL).select("path", "node", F.lit(True).alias("core")))
        large = live.where(F.col("size") > SMALL)
        rows = large.count()
        if not rows:
            break
        if before is not None and rows > 0.7 * before:
            core = max(0, core - TOKENS // 8)
        before = rows
        judged = cut(_judged(large, nodes))
        # the bucket's core starts at: 0 for a leaf; one without a core gets no group
        kinds = judged.groupBy(F.col("path").alias("__path")).agg(
            F.when((F.first("size") <= WHOLE) & (F.avg("agree") >= ALIKE), 0).otherwise(core).alias("__from"), F.max("agree").alias("__most")
        )
        judged = judged.join(kinds, F.col("path") == F.col("__path")).withColumn("core", F.col("agree") >= F.col("__from"))
        groups.append(judged.where((F.col("agree") >= F.col("__from") - APART) & (F.col("__most") >= F.col("__from"))).select("path", "node", "core"))
        more = judged.where("not core").join(nodes.select("node", "tokens"), "node").select("path", "node", "tokens")
        live = cut(_with_sizes(more.mapInArrow(_split, "path long, node binary").distinct()))
    out = reduce(DataFrame.unionByName, small)
    return cut(out.unionByName(_merged(reduce(DataFrame.unionByName, groups))) if groups else out)


def in_groups(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Leaves to groups of rows that one task compares: small leaves as they are, larger ones as pairs of blocks of the core,
    and of a block of the core and one of the rim. ``side``: rows of one side have no pairs, but those of side 0.
    ``weight``: a column of items, whose sum bounds blocks too."""
    sizes = rows.groupBy(F.col("path").alias("__path")).agg(*[
        f.alias(f"__{name}{kind}") for kind, own in (("core", F.col("core")), ("rim", ~F.col("core")))
        for name, f in (("n_", F.count_if(own)), ("w_", F.sum(F.when(own, F.col(weight) if weight else 0).otherwise(0))))
    ])
    blocks = lambda kind: F.ceil(F.greatest(F.col(f"__n_{kind}") / BLOCK, F.col(f"__w_{kind}") / ITEMS)).cast("int")
    met = rows.join(sizes, F.col("path") == F.col("__path")).withColumns({"__core": blocks("core"), "__rim": blocks("rim")})
    met = met.withColumn("__one", (F.col("__n_core") + F.col("__n_rim") <= BLOCK) & (F.col("__w_core") + F.col("__w_rim") <= ITEMS))
    whole = met.where("__one").withColumns({"group": F.col("path"), "side": F.when(F.col("core"), 0).otherwise(1)})
    own = F.pmod(F.xxhash64("node", "path"), F.when(F.col("core"), F.col("__core")).otherwise(F.col("__rim"))).cast("int")
    # blocks of the core are numbered from 0, those of the rim from -1 down
    other = F.when(F.col("core"), F.sequence(-F.col("__rim"), F.col("__core") - 1)).otherwise(F.sequence(F.lit(0), F.col("__core") - 1))
    parts = met.where("not __one").withColumns({"__own": F.when(F.col("core"), own).otherwise(-1 - own), "__other": F.explode(other)})
    group = F.xxhash64("path", F.least("__own", "__other"), F.greatest("__own", "__other"))
    side = F.when(F.col("__own") == F.col("__other"), 0).when(F.col("__own") < F.col("__other"), 1).otherwise(2)
    parts = parts.withColumns({"group": group, "side": side})
    return whole.select(*rows.columns, "group", "side").unionByName(parts.select(*rows.columns, "group", "side"))


def by_group(batches: Iterator[pa.RecordBatch], at: int, rows: int = 20_000) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by a column, some thousands of rows at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held)
        key = whole.column(at).to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1])
        if len(change):
            stop = int(change[-1]) + 1
            yield whole.slice(0, stop)
            whole = whole.slice(stop)
        held, count = whole.to_batches(), whole.num_rows
    if count:
        yield pa.Table.from_batches(held)


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all pairs inside groups, in parts; of groups with sides, pairs of different sides."""
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    begin, size = starts[:-1], np.diff(starts)
    last = np.repeat(begin + size, size)  # of each row, the end of its group
    more = last - np.arange(len(group)) - 1
    rows = np.arange(len(group))
    total = np.cumsum(more)
    start = 0
    while start < len(rows):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + 200_000, side="right")))
        n = more[start:stop]
        i = np.repeat(rows[start:stop], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = (side[i] == 0) | (side[i] != side[j])
        yield i[ok], j[ok]
        start = stop


class _Leaves:
    """Whether a pair of rows is compared in a leaf less than its own: one that both are in, one of them at least in its core. From
    each row's sorted lists of all such leaves (``below``) and of those in whose core it is (``core_below``)."""

    def __init__(self, t: pa.Table):
        every, core = (self._column(t, c) for c in ("below", "core_below"))
        values, rank = np.unique(every[1], return_inverse=True)
        self.width = len(values) + 1
        self.keys = np.repeat(np.arange(len(every[0])), every[0]) * self.width + rank
        self.counts, self.rank = core[0], np.searchsorted(values, core[1])
        self.starts = np.cumsum(self.counts) - self.counts

    @staticmethod
    def _column(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = t.column(name).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs that share no such leaf."""
        out = np.ones(len(i), bool)
        for one, two in ((i, j), (j, i)) if len(self.rank) else ():
            n = self.counts[one]
            total, start = np.cumsum(n), 0
            while start < len(one):
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + 1_000_000, side="right")))
                m = n[start:stop]
                pair = np.repeat(np.arange(start, stop), m)
                at = self.starts[one[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
                wanted = two[pair] * self.width + self.rank[at]
                found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                out[pair[self.keys[found] == wanted]] = False
                start = stop
        return out


def _likely(threshold: float):
    need = math.floor(TOKENS * (threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / TOKENS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, 0):
            group, side, n = (t.column(c).to_numpy() for c in ("group", "side", "n"))
            marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, TOKENS)
            shared = None
            found = np.zeros(len(group), bool)
            for i, j in _pairs(group, side):
                ok = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                ok = (marks[i] == marks[j]).sum(1) >= need
                i, j = i[ok], j[ok]
                if len(i):
                    shared = shared or _Leaves(t)
                    ok = shared.apart(i, j)
                    found[i[ok]] = found[j[ok]] = True
            if found.any():
                keep = t.filter(pa.array(found))
                yield from keep.select(["path", "node", "core"]).combine_chunks().to_batches()

    return run


def _sets(table: Broadcast):
    """Nodes and their sets, from the texts whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = batch.column(1).filter(pa.array(bits[h >> 3] >> (h & 7) & 1 == 1))
            for _, data, offsets in ranges(wanted):
                made = [s for s in shingles(data, offsets) if len(s)]
                for start in range(0, len(made), 256):
                    part = [s.tobytes() for s in made[start : start + 256]]
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in part], pa.binary()), pa.array(part, pa.binary())], ["node", "items"])

    return run


def _bit_table(ids: DataFrame, bits: int) -> bytes:
    """A bit for each hash that occurs; of a fixed size, whatever the number of rows."""
    word = 1 << 15
    rows = ids.groupBy(F.floor(F.col("h") / word).alias("at")).agg(F.bitmap_construct_agg(F.col("h") % word).alias("bits")).collect()
    out = bytearray(bits // 8)
    for r in rows:
        out[r["at"] * word // 8 : (r["at"] + 1) * word // 8] = r["bits"]
    return bytes(out)


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, 0, 2000):
            group, side, weight = (t.column(c).to_numpy() for c in ("group", "side", "weight"))
            column = t.column("items")
            shared = _Leaves(t)
            links = np.zeros(len(group), np.int64)
            left: list[int] = []
            right: list[int] = []
            for begin, stop in _bounds(group):
                items = [np.frombuffer(x, np.uint64) for x in column.slice(begin, stop - begin).to_pylist()]
                common = _overlaps(items)
                sizes = np.array(list(map(len, items)))
                i, j = np.nonzero(np.triu(common >= threshold * (sizes[:, None] + sizes - common), 1))
                i, j = i + begin, j + begin
                ok = (side[i] == 0) | (side[i] != side[j])
                i, j = i[ok], j[ok]
                for k in range(0, len(i), STEP):
                    a, b = i[k : k + STEP], j[k : k + STEP]
                    ok = shared.apart(a, b)
                    a, b = a[ok], b[ok]
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    left += a.tolist()
                    right += b.tolist()
            root = np.array(local_roots(left, right, len(group)))
            keep = np.flatnonzero((links > 0) | (root != np.arange(len(group))))
            if len(keep):
                node = t.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(keep)), pa.array(links[keep]), node.take(pa.array(root[keep]))], ["node", "links", "root"])

    return run


def _bounds(group: np.ndarray) -> list[tuple[int, int]]:
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    return list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))


def _overlaps(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    sizes = [len(x) for x in items]
    _, code, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
    many = often[code] > 1
    code, row = code[many], row[many]
    # what the same sets hold, most of what near copies share, is one column with a weight
    order = np.lexsort((row, code))
    code, row = code[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    sign = np.add.reduceat(_ROWS[row % len(_ROWS)] * (row.astype(np.uint64) * np.uint64(2) + np.uint64(1)), starts) if len(starts) else np.empty(0, np.uint64)
    count = np.diff(starts, append=len(code))
    _, first, weight = np.unique(np.stack([sign, count.astype(np.uint64)], 1), axis=0, return_index=True, return_counts=True)
    out = np.zeros((len(items), len(items)), np.float32)
    step = max(1, 4_000_000 // max(1, len(items)))
    for low in range(0, len(first), step):
        part = first[low : low + step]
        n = count[part]
        at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        held = np.zeros((len(items), len(part)), np.float32)
        held[row[at], np.repeat(np.arange(len(part)), n)] = 1
        out += (held * weight[low : low + step].astype(np.float32)) @ held.T
    np.fill_diagonal(out, sizes)
    return np.rint(out).astype(np.int64)


def _listed(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of leaves with the columns of their node, and ``below`` and ``core_below``, the node's leaves that are less."""
    lists = found.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("path", "core"))).alias("__leaves"))
    rows = lists.join(nodes, "node").select("*", F.explode("__leaves").alias("__leaf")).withColumns({"path": F.col("__leaf.path"), "core": F.col("__leaf.core")})
    below = lambda core: F.transform(F.filter("__leaves", lambda x: (x["path"] < F.col("path")) & (x["core"] | F.lit(not core))), lambda x: x["path"])
    return rows.withColumns({"below": below(False), "core_below": below(True)}).drop("__leaves", "__leaf")


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One row for each row given: the key, ``n_links`` (other rows at least so similar), ``class_id`` (the least key
    that links reach), ``n_shingles`` and ``node`` (equal for equal sets)."""
    given = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    sketched = cut(given.mapInArrow(_sketch, f"id {df.schema[key].dataType.simpleString()}, node binary, n int, tokens binary"))
    nodes = cut(sketched.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    found = leaves(nodes, runs_for(target, threshold))
    parts = max(partitions(df), 8)
    # one byte of each token is enough to judge by
    marks = nodes.select("node", "n", F.unhex(F.regexp_replace(F.hex("tokens"), "(..)......", "$1")).alias("marks"))
    first = in_groups(_listed(found, marks)).repartition(parts, "group").sortWithinPartitions("group")
    first = first.select("group", "path", "side", "core", "node", "n", "marks", "below", "core_below")
    likely = cut(first.mapInArrow(_likely(threshold), "path long, node binary, core boolean").distinct())
    wanted = likely.select("node").distinct().join(nodes.select("node", "id", "n", "weight"), "node")
    pairs = in_groups(_listed(likely, wanted.select("node", "n", "weight")), "n")
    bits = min(BITS, 1 << max(15, (8 * wanted.count()).bit_length()))
    h = F.pmod(F.xxhash64("id"), F.lit(bits))
    table = df.sparkSession.sparkContext.broadcast(_bit_table(wanted.select(h.alias("h")), bits))
    items = given.select(h.alias("h"), "text").mapInArrow(_sets(table), "node binary, items binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    second = pairs.join(items, "node").select("group", "side", "node", "weight", "below", "core_below", "items")
    second = second.repartition(parts, "group").sortWithinPartitions("group")
    linked = cut(second.mapInArrow(_exact(threshold), "node binary, links long, root binary"))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = groups.join(nodes.select("node", "id"), "node")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    told = nodes.join(counts, "node", "left").join(groups, "node", "left").join(least, "component", "left")
    told = told.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "id").alias("class_id"))
    return sketched.select("id", "n", "node").join(told, "node", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "id").alias("class_id"), F.col("n").alias("n_shingles"), "node"
    )
