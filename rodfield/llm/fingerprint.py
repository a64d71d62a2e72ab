"""Document fingerprints: a homomorphic multiset hash.

A text is a multiset of paragraphs. Every paragraph is hashed to a wide vector, and a
text's fingerprint is the sum of the vectors modulo powers of two. So the order of
paragraphs does not matter, and inserting or deleting a paragraph adds or subtracts
its vector (:func:`add`, :func:`subtract`). The vector has two parts:

- identity: 8 lanes modulo 2^40, hashed from the whole paragraph (320 bits);
- likeness: the number of word triples and, for each of 60 lanes, how many of them
  hash to one in that lane's bit, modulo 2^31. As sums they follow edits as well, and
  the cosine of the centred lanes estimates how much of two texts is the same.

Only DataFrame functions are used. Lanes are packed two to a long, summed by an
ordinary aggregate with a map-side part; one small row a text is shuffled.

Defined results: a null text is empty; empty texts have an all-zero fingerprint, are
alike with likeness 1 and unlike any other text (0); paragraphs of white space only
carry identity but no likeness; paragraphs without characters count for nothing, so that
"a\\n\\nb" and "a\\nb" are one multiset; a paragraph of one or two words counts as one triple;
repeated rows have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rodfield.llm._common import text_of
from rodfield.llm.ring import range_of, with_next

IDENTITY, IDENTITY_BITS, PACKED = 8, 40, 30
_MASK = (1 << IDENTITY_BITS) - 1
_PAIR = 1 | 1 << 32
_LANE = (1 << 31) - 1


def paragraphs(text: Column) -> Column:
    """The lines of a text; none for the empty text."""
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def identity(text: Column) -> Column:
    """The identity lanes of a text."""
    pairs = F.transform(paragraphs(text), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(11), p).alias("b")))
    names = [f"l{i}" for i in range(IDENTITY)]
    lane = lambda s, p, i: (s[names[i]] + F.xxhash64(F.lit(i), p["a"], p["b"]).bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK))
    # all lanes in one pass over the paragraphs
    return F.aggregate(
        pairs, F.struct(*[F.lit(0).cast("long").alias(n) for n in names]), lambda s, p: F.struct(*[lane(s, p, i).alias(n) for i, n in enumerate(names)]), lambda s: F.array(*[s[n] for n in names])
    )


def triples(text: Column) -> Column:
    """Hashes of the word triples of every paragraph."""
    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        return F.when(F.size(words) >= 3, many).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))

    words = F.transform(paragraphs(text), lambda p: F.filter(F.split(p, " "), lambda w: w != ""))
    return F.flatten(F.transform(words, of))


def packed_lanes(h: Column) -> list[Column]:
    """Two bits of a hash in each long, 32 places apart."""
    return [F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR)) for i in range(PACKED)]


def add(a: Column, b: Column) -> Column:
    """Sum of two fingerprint vectors (structs of ``identity``, ``n`` and ``lanes``): the fingerprint of both texts' paragraphs together."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Difference of two vectors: the fingerprint after the second's paragraphs are deleted from the first."""
    return _combine(a, b, -1)


def _combine(a: Column, b: Column, sign: int) -> Column:
    half = lambda x, low: (x if low else F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(_LANE))
    lane = lambda x, y, low: F.pmod(half(x, low) + F.lit(sign) * half(y, low), F.lit(1 << 31))
    return F.struct(
        F.zip_with(a["identity"], b["identity"], lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(1 << IDENTITY_BITS))).alias("identity"),
        F.pmod(a["n"] + F.lit(sign) * b["n"], F.lit(1 << 31)).alias("n"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: lane(x, y, True) + F.shiftleft(lane(x, y, False), 32)).alias("lanes"),
    )


def as_string(vector: Column) -> Column:
    """The vector as lower-case hex."""
    digits = lambda a, n: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(digits(vector["identity"], IDENTITY_BITS // 4), digits(F.array(vector["n"]), 8), digits(vector["lanes"], 16))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the centred lanes, 1 for equal vectors, 0 if just one text has no words."""
    def centred(v: Column) -> Column:
        low = F.transform(v["lanes"], lambda x: (2 * x.bitwiseAND(F.lit(_LANE)) - v["n"]).cast("double"))
        return F.concat(low, F.transform(v["lanes"], lambda x: (2 * F.shiftrightunsigned(x, 32) - v["n"]).cast("double")))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = centred(a), centred(b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / F.when(size > 0, size))))


def fingerprint(df: DataFrame, texts: list[str], keys: list[str]) -> DataFrame:
    """The keys and, for each named text column, a vector of the same name. Keys need not be unique: rows are told apart
    by a number of their own, given and used within one stage."""
    one = lambda i, c: F.struct(F.lit(i).alias("of"), identity(text_of(c)).alias("identity"), triples(text_of(c)).alias("triples"))
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    rows = numbered.select("__row", *keys, F.explode(F.array(*[one(i, c) for i, c in enumerate(texts)])).alias("t"))
    units = rows.select("__row", *keys, F.col("t.of").alias("__of"), F.col("t.identity").alias("__identity"), F.explode_outer("t.triples").alias("__h"))
    sums = [F.sum(F.coalesce(x, F.lit(0).cast("long"))).alias(f"__l{i}") for i, x in enumerate(packed_lanes(F.col("__h")))]
    whole = units.groupBy("__row", *keys, "__of", "__identity").agg(F.count("__h").alias("__n"), *sums)
    vector = F.struct(F.col("__identity").alias("identity"), F.col("__n").alias("n"), F.array(*[F.col(f"__l{i}") for i in range(PACKED)]).alias("lanes"))
    side = [F.max(F.when(F.col("__of") == i, vector)).alias(c) for i, c in enumerate(texts)]
    return whole.groupBy("__row", *keys).agg(*side).drop("__row")


def edited_by_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text with its last third replaced by the start of the next text in descending key order. Columns: the key,
    ``tie``, ``bucket``, ``text``, ``edited``, ``n_chars``."""
    base = df.select(F.col(key), text_of(text).alias("text"))
    base = base.withColumn("tie", F.sha2("text", 256)).withColumn("bucket", range_of(df, key))
    rows = with_next(base, key, "tie", ["text"], "bucket")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    return rows.select(key, "tie", "bucket", "text", edited.alias("edited"), n.cast("long").alias("n_chars"))


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likenesses to the edited form and to the next text."""
    rows = edited_by_next(df, key, text).withColumn("edited_sha256", F.sha2("edited", 256))
    both = fingerprint(rows, ["text", "edited"], [key, "tie", "bucket", "n_chars", "edited_sha256"])
    out = with_next(both, key, "tie", ["text"], "bucket")
    return out.select(
        key, "n_chars", "edited_sha256", as_string(F.col("text")).alias("fingerprint"), as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("next.text")).alias("near_next"),
    )
