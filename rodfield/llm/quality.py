"""Quality classifier: supervised subword embeddings.

Every word has a hashed bucket of its own and one for each of its character n-grams
(3 and 4, with marks for the word's ends); a bucket's embedding is learned. A word is the
mean of its buckets. A document is half the mean of its words, half the mean of two
words that stand for how it repeats itself: its share of distinct words and the share of
its most frequent one, each with its length, as powers of two. A softmax layer over that
gives the probabilities of the labels. Training is numpy stochastic gradient descent
with Adagrad steps in one task, on a bounded sample: the ``TRAIN`` labelled documents
with the smallest hashes of their ids (a documented parameter), whole texts.

As the layers are linear, a trained model is one number a bucket. Scoring is one pass
over the table without a shuffle; workers score each distinct word once.

Defined results: a null text is empty; an empty text has no words and gets the score of
the intercept; null labels are no labels; of several labels for one id the largest
counts; without labelled rows, or with one label only, the score is the share of label
1 (0.5 without any); rows with null ids are scored and not held out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rodfield.llm.chunks import ChunkTable, ranges

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4)
TRAIN, STEPS, BATCH, RATE = 4000, 400, 32, 0.4


_STEP = np.uint64(6364136223846793005)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, one word after another, and how many each has: its own and those of its n-grams of code points."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # code points from here to the word's end
    powers = np.full(int(sizes.max()), _STEP)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    whole = np.add.reduceat(points * powers[np.repeat(sizes, sizes) - left], ends - sizes)
    ids, of = [_bucket(whole, 1)], [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        ids.append(_bucket(sum(points[at + k] * powers[k] for k in range(n)) if len(at) else np.empty(0, np.uint64), n))
        of.append(word[at])
    of_all = np.concatenate(of)
    return np.concatenate(ids)[np.argsort(of_all, kind="stable")], np.bincount(of_all, minlength=len(words))


def shape_words(total: np.ndarray, distinct: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Buckets of the two words for a document's repetition, a row for each document of so many chunks."""
    n = np.maximum(total, 1)
    size = np.log2(n).astype(np.int64)
    spread, share = (np.floor(-2 * np.log2(np.maximum(x, 1) / n)).astype(np.int64) for x in (distinct, top))
    made = [[zlib.crc32(f"\0distinct {a} {c}".encode()) % BUCKETS, zlib.crc32(f"\0top {b} {c}".encode()) % BUCKETS] for a, b, c in zip(spread.tolist(), share.tolist(), size.tolist(), strict=True)]
    return np.array(made, np.int64).reshape(-1, 2)


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """One number a bucket, and the intercept: a document's mean of them plus the intercept is the log odds."""
    share = float(np.mean(labels)) if labels else 0.5
    if share in (0.0, 1.0) or not labels:
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    table: dict[str, int] = {}
    docs, shape = [], []
    for text in texts:
        words, counts = np.unique(np.array([table.setdefault(w, len(table)) for w in text.split()], np.int64), return_counts=True)
        docs.append((words, counts / max(1, counts.sum()) / 2))
        chunks = Counter(text.split(" ")) if text else {}
        shape.append((sum(chunks.values()), len(chunks), max(chunks.values(), default=0)))
    shapes = shape_words(*np.array(shape).T)
    flat, sizes = features(list(table))
    begins = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    emb, steps = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.full(BUCKETS, 1e-4, np.float32)
    out, bias, out_steps = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2), np.full((DIM + 1, 2), 1e-4)
    target = np.eye(2)[np.array(labels)]
    for _ in range(-(-STEPS * BATCH // len(docs))):
        order = rng.permutation(len(docs))
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            words = np.concatenate([docs[i][0] for i in part])
            row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            size = sizes[words]
            ends = np.cumsum(size)
            ids = flat[np.repeat(begins[words] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            weight = np.repeat(np.concatenate([docs[i][1] for i in part]) / size, size).astype(np.float32)
            ids, weight = np.concatenate([ids, shapes[part].ravel()]), np.concatenate([weight, np.full(2 * len(part), 0.25, np.float32)])
            at = np.concatenate([np.repeat(row, size), np.repeat(np.arange(len(part)), 2)])
            given = emb[ids] * weight[:, None]
            hidden = np.stack([np.bincount(at, given[:, d], len(part)) for d in range(DIM)], 1)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target[part]) / len(part)
            grad_out = np.vstack([hidden.T @ error, error.sum(0)])
            back = (error @ out.T).astype(np.float32)[at] * weight[:, None]
            grad = np.stack([np.bincount(ids, back[:, d], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
            steps += (grad**2).mean(1)
            emb -= RATE * grad / np.sqrt(steps)[:, None]
            out_steps += grad_out**2
            step = RATE * grad_out / np.sqrt(out_steps)
            out, bias = out - step[:-1], bias - step[-1]
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN) -> tuple[np.ndarray, float]:
    """Trains on at most ``rows`` labelled documents that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(rows)
    given = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), key)
    # the ids are unique in the sample; of documents that share an id, any text will do
    given = given.groupBy(key).agg(F.max(F.struct("__text", "__label")).alias("r")).select(F.col(key).alias("k"), "r.__text", "r.__label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        weights, bias = train([r[1] for r in got], [r[2] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    model = given.coalesce(1).mapInArrow(learn, "weights binary, bias double").collect()
    return (np.frombuffer(model[0]["weights"], np.float32), model[0]["bias"]) if model else train([], [])


class _Scores(ChunkTable):
    """Sums of the words' numbers, and how many words, of each chunk."""

    limit = 32_000_000

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.sums, self.words = np.zeros(1 << 14), np.zeros(1 << 14)

    def learn(self, chunks: list[bytes]) -> None:
        first = len(self.at)
        while len(self.sums) < first + len(chunks):
            self.sums, self.words = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.words))
        cut = [chunk.decode("utf-8", "replace").split() for chunk in chunks]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        ids, sizes = features([w for words in cut for w in words])
        self.words[first : first + len(cut)] = counts
        if len(ids):
            means = np.add.reduceat(self.weights[ids].astype(np.float64), np.cumsum(sizes) - sizes) / sizes
            self.sums[first : first + len(cut)] = np.bincount(np.repeat(np.arange(len(cut)), counts), means, len(cut))

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean number of each text."""
        n = len(offsets) - 1
        raw, chunks, sizes = data.tobytes(), [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            parts = raw[a:b].split(b" ") if a < b else []
            chunks += parts
            sizes.append(len(parts))
        distinct, top, words = np.zeros(n), np.zeros(n), np.zeros(n)
        if chunks:
            at, text = self.numbers(chunks), np.repeat(np.arange(n), sizes)
            words = np.bincount(text, self.sums[at], n) / np.maximum(np.bincount(text, self.words[at], n), 1)
            pairs, counts = np.unique(text * (len(self.at) + 1) + at, return_counts=True)
            of = pairs // (len(self.at) + 1)
            distinct = np.bincount(of, minlength=n)
            np.maximum.at(top, of, counts)
        return words / 2 + self.weights[shape_words(np.array(sizes), distinct, top)].mean(1) / 2


_kept: dict[int, _Scores] = {}


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", into: str = "score") -> DataFrame:
    """All columns and the probability of label 1."""
    weights, bias = model
    context = df.sparkSession.sparkContext
    sent = context.broadcast(weights)
    kinds = [f for f in df.schema.fields if f.name != into]
    names = [f.name for f in kinds]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = zlib.crc32(sent.value.tobytes())
        if mark not in _kept:
            _kept.clear()
            _kept[mark] = _Scores(sent.value)
        for batch in batches:
            means = [_kept[mark].of(data, offsets) for _, data, offsets in ranges(batch.column(at))]
            odds = np.concatenate(means) + bias if means else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(odds, -60, 60))))], [*names, into])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, type(df.schema)([*kinds]).add(into, "double"))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, ``held_out``, ``score`` and ``predicted``; trained on the labels of rows that are not held out."""
    scored = score(df, fit(df, labels, key, text), text)
    return scored.withColumns({"held_out": held_out(F.col(key)), "predicted": (F.col("score") >= 0.5).cast("int")})
