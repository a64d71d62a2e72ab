"""Fill-in-middle transformation: a document is cut into prefix, middle and suffix, and written so that the middle comes last.

The places where code points begin are a :class:`~rodfield.llm.boundary_set.BoundarySet`; both cuts are
drawn as counts of code points and found in it as byte offsets, so texts are cut as bytes, without
being decoded. Draws are a hash of a seed and the document's id: reruns agree, and no state is
shared between tasks. One pass over the documents, no shuffle.

Forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) and ``plain`` (the text as it is).
Plain are empty texts, texts that hold one of the three marks themselves (so every output can be
read back) and a share of all others.

Defined results: a null text is empty; a null id draws as the empty string; rows with equal ids draw alike; a byte
that is no continuation byte begins a code point; columns of the caller keep their names and values, and clashing
names of the operator's own give way to these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rodfield.llm._common import fresh, text_of
from rodfield.llm.boundary_set import code_point_bounds

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and of these percent written suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of text that a batch of results holds before it is handed on.
HANDED = 1 << 24


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def transform(data: bytes, drawn: tuple[int, int, int, int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[bytes, str, int, int | None, int | None]:
    """The output, its form, the code points of the text, of its prefix and of its middle (None if plain)."""
    bounds = code_point_bounds(data)
    n = len(bounds) - 1
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or drawn[2] % 100 >= rate or any(m in data for m in marks):
        return data, "plain", n, None, None
    low, high = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = bounds.select(low), bounds.select(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = marks
    if drawn[3] % 100 < suffix_first:
        return b"".join([s, suffix, p, prefix, m, middle]), "spm", n, low, high - low
    return b"".join([p, prefix, s, suffix, m, middle]), "psm", n, low, high - low


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form. No mark is in any part, and none can arise where a part meets a mark."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, len(first) + 1, 2147483647)
        tail = F.split_part(rest, F.lit(second), F.lit(2))
        return F.split_part(rest, F.lit(second), F.lit(1)), F.split_part(tail, F.lit(MIDDLE), F.lit(1)), F.split_part(tail, F.lit(MIDDLE), F.lit(2))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(late_prefix, late_middle, late_suffix))


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """All columns, and ``output``, ``form``, ``n`` (code points of the text), ``prefix_chars`` and ``middle_chars`` (null if plain)."""
    own = [fresh(df, c) for c in ("output", "form", "n", "prefix_chars", "middle_chars")]
    data, name = fresh(df, "__data"), fresh(df, "__key")
    schema = StructType([*df.schema.fields, StructField(own[0], StringType()), StructField(own[1], StringType()), *(StructField(c, LongType()) for c in own[2:])])
    given = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, made = 0, 0, []
            for i in range(batch.num_rows):
                made.append(transform(batch.column(given)[i].as_py(), draws(seed, batch.column(given + 1)[i].as_py()), rate, suffix_first))
                size += len(made[-1][0])
                if size >= HANDED or i + 1 == batch.num_rows:
                    columns = [pa.array([r[0] for r in made], pa.binary()).view(pa.string()), pa.array([r[1] for r in made], pa.string())]
                    columns += [pa.array([r[c] for r in made], pa.int64()) for c in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(made)).columns[:given], *columns], [f.name for f in schema.fields])
                    start, size, made = i + 1, 0, []

    rows = df.withColumn(data, text_of(text).cast("binary")).withColumn(name, F.col(key).cast("string"))
    return rows.mapInArrow(run, schema)
