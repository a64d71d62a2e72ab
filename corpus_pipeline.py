"""The corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and returns what it keeps with the same
columns; the last returns the pieces of packed windows. A stage works on all that its predecessor kept.

1. quality: documents that the quality classifier rejects go (score under 0.5).
2. line_dedup: later copies of repeated runs of lines are deleted; documents of which no text is left go, ``n_chars`` is
   that of the text left.
3. ngram_jaccard: of each group of near duplicates (Jaccard similarity of five-word shingles of 0.8 or more, linked
   through any number of members) the document with the least id stays. Rows that share an id stay or go together.
4. packing: what is left, in windows of at most 1024 ids.

Null texts count as empty and are kept by the first three stages unless the classifier rejects them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rodfield.llm._common import cut, table
from rodfield.llm.jaccard_join import jaccard_join
from rodfield.llm.line_dedup import dedup_lines
from rodfield.llm.packing import pack
from rodfield.llm.quality import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines."""
    left = dedup_lines(docs.select(*COLUMNS)).where("n_deleted = 0 or trim(text) != ''")
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    found = jaccard_join(docs.select("doc_id", "text"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id")).distinct()
    left = docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return left.withColumn("__mark", F.xxhash64("text")).dropDuplicates(["doc_id", "__mark"]).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("packing", packing),
]

#: SQL cannot express training, random paths or differencing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's result is cut before the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = cut(docs)
    return docs
