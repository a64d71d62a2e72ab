"""Mixing sources to target weights by weighted sampling without replacement.

Every document has a key: an exponential draw divided by its quality weight, so that in the order of keys a document
comes early in proportion to its weight (Efraimidis and Spirakis, 2006). A source whose target is more
than its size is taken whole as many times as it fits (complete epochs); the rest of its budget goes to
its documents in the order of keys, up to the place where their sizes sum to the budget. The document at that place is taken in part.

The order inside a source is never sorted as a whole. Keys fall into cells of their logarithm, sizes are summed by
source and cell (summed up per task first), and the cell in which the budget ends is found by a running sum over
cells; twice more inside that cell, and only what is left there is sorted. So a source with a third of all
rows costs what its rows cost. What comes of it is one place a source, with which each document is compared.
Tables of a row a source are broadcast while they are small by count and bytes, else joined with salts.

DataFrame functions only; the draws are hashes of a seed, the id and the text, so reruns agree.

Defined results: a null text is empty and has size 0; documents of size 0 are taken with 0 words; a null source is a source, and
comes last; a source of size 0 has target 0; rows with equal id and text share a key, and if the budget ends among them some are taken
and some not, in no set order; a weight that is null or below 0.01 counts as 0.01; empty tables give empty results; the caller's
columns keep their names and values, except that names that begin with ``mix_`` are the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodfield.llm._common import cut, fresh, partitions, text_of

SPACE = r"[\x20\x09-\x0D]+"
#: Most copies of a document, and the weights that sources get in turn.
MOST, TURN = 3.0, (1, 2, 3)
#: Most sources and bytes of their names whose tables are broadcast, and salts of the join beyond.
SOURCES, NAME_BYTES, SALTS = 10_000, 1 << 20, 64
#: A key's cell: its logarithm (base 2, from -64 on) in parts of 2^-36; three levels of 14 bits tell the cell.
PARTS, LEVELS, BITS = 36, 3, 14
LEAST_WEIGHT = 0.01


def words_of(text: str) -> Column:
    """The words of a text: what white space parts."""
    return F.filter(F.split(text_of(text), SPACE), lambda w: w != "")


def variety(words: Column) -> Column:
    """A weight between 0.1 and 1: distinct words by the root of all words, in fifths. Repetitive and very short texts have the least."""
    share = F.size(F.array_distinct(words)) / F.sqrt(F.greatest(F.size(words), F.lit(1))) / 5
    return F.least(F.greatest(share, F.lit(0.1)), F.lit(1.0))


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, weight: Column | None = None) -> DataFrame:
    """All columns, and ``mix_source``, ``mix_size`` (words), ``mix_mark`` (a hash) and ``mix_key``, what :func:`mix` goes by. ``weight``: a column
    of quality, by default :func:`variety` of the words."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), text_of(text)), 256)
    rows = df.withColumn("mix_words", words_of(text)).withColumns({"mix_size": F.size("mix_words").cast("long"), "mix_mark": mark, "mix_source": F.col(source)})
    quality = F.greatest(F.coalesce(variety(F.col("mix_words")) if weight is None else weight.cast("double"), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    drawn = (F.conv(F.substring("mix_mark", 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return rows.withColumn("mix_key", -F.log(drawn) / quality).drop("mix_words")


def numbered(sources: DataFrame) -> DataFrame:
    """``place`` of each source by code point, from 0, null last, without one task that has them all."""
    order = [F.col("mix_source").isNull(), F.col("mix_source")]
    dealt = cut(sources.repartitionByRange(partitions(sources), *order).withColumn("__part", F.spark_partition_id()))
    inside = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row a partition of the shuffle
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inside.join(before, "__part").withColumn("place", F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """``target`` of each source: all sizes shared out by ``share``, none above ``most`` times its size; what is above goes to the others by
    their shares, until none is above. ``sources``: mix_source, source_size, share."""
    capped = F.lit(False)
    limit = F.col("source_size") * most
    while True:
        state = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)).alias("gone"),
            F.coalesce(F.sum(F.when(~capped, F.col("share"))), F.lit(0)).alias("shares"), F.count_if(capped).alias("n"),
        ).first()
        open_ = F.lit(float(state["all"] - state["gone"])) * F.col("share") / F.lit(float(state["shares"] or 1))
        above = capped | (open_ > limit)
        if sources.agg(F.count_if(above)).first()[0] == state["n"]:
            return sources.withColumn("target", F.when(capped, limit).otherwise(open_))
        # what an open source may get only grows, so a source above its limit stays so
        capped = above


def _by_source(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How rows meet a table with one row a source."""
    table = cut(table)
    size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("mix_source").cast("string"))).alias("bytes")).first()
    side = table.withColumnRenamed("mix_source", "__source")
    same = F.col("mix_source").eqNullSafe(F.col("__source"))
    if size["n"] <= SOURCES and (size["bytes"] or 0) <= NAME_BYTES:
        return lambda rows: rows.join(F.broadcast(side), same, "left").drop("__source")
    salted = side.withColumn("__with", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64("mix_mark"), F.lit(SALTS)).cast("int")
    return lambda rows: rows.withColumn("__salt", spread).join(salted, same & (F.col("__salt") == F.col("__with")), "left").drop("__source", "__salt", "__with")


def _cell(level: int) -> Column:
    """The cell of a key at a level, inside that of the level above."""
    whole = F.floor((F.log2("mix_key") + 64) * float(1 << PARTS)).cast("long")
    return F.pmod(F.shiftright(whole, BITS * (LEVELS - 1 - level)), F.lit(1 << BITS)) if level else F.shiftright(whole, BITS * (LEVELS - 1))


def places(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source with a budget the key and mark of the document where it ends (``end_key``, ``end_mark``, and ``end_row``, which tells equal
    rows apart) and the words taken of it (``part``)."""
    kept = rows.where("mix_size > 0").select("mix_source", "mix_size", "mix_key", "mix_mark", "mix_row")
    at = budgets.where("budget > 0").select("mix_source", "budget")
    path: list[str] = []
    for level in range(LEVELS):
        inside = _by_source(at)(kept).where("budget is not null")
        for k, name in enumerate(path):
            inside = inside.where(_cell(k) == F.col(name))
        sums = inside.groupBy("mix_source", *path, _cell(level).alias(f"c{level}")).agg(F.sum("mix_size").alias("size"), F.first("budget").alias("budget"))
        upto = F.sum("size").over(Window.partitionBy("mix_source").orderBy(f"c{level}"))
        ends = sums.withColumn("upto", upto).where("upto - size < budget and budget <= upto")
        path.append(f"c{level}")
        at = ends.select("mix_source", *path, (F.col("budget") - F.col("upto") + F.col("size")).alias("budget"))
    last = _by_source(at)(kept).where("budget is not null")
    for k, name in enumerate(path):
        last = last.where(_cell(k) == F.col(name))
    upto = F.sum("mix_size").over(Window.partitionBy("mix_source").orderBy("mix_key", "mix_mark", "mix_row").rowsBetween(Window.unboundedPreceding, 0))
    ends = last.withColumn("upto", upto).where("upto - mix_size < budget and budget <= upto")
    return ends.select("mix_source", F.col("mix_key").alias("end_key"), F.col("mix_mark").alias("end_mark"), F.col("mix_row").alias("end_row"), (F.col("budget") - F.col("upto") + F.col("mix_size")).alias("part"))


def mix(rows: DataFrame, shares: Sequence[float] = TURN, most: float = MOST) -> DataFrame:
    """All columns of rows that are measured, and ``size``, ``source_size``, ``target`` (of the source), ``epochs`` (whole copies of the document),
    ``part`` (words of a further copy) and ``taken`` (words of them all). ``shares``: weights that sources get in turn. The rows are
    read a few times: hand over a stored table where their measures are dear."""
    own = ["mix_source", "mix_size", "mix_key", "mix_mark"]
    others = [c for c in rows.columns if c not in own]
    kept = rows.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("given")).withColumn("mix_row", F.monotonically_increasing_id())
    sizes = numbered(kept.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size")))
    share = F.element_at(F.array(*map(F.lit, shares)), (F.pmod("place", F.lit(len(shares))) + 1).cast("int"))
    goal = targets(cut(sizes.withColumn("share", share).drop("place")), most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = cut(goal.withColumn("whole", full).withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    ends = places(kept, goal).withColumnRenamed("mix_source", "__s")
    goal = goal.join(ends, F.col("mix_source").eqNullSafe(F.col("__s")), "left").drop("__s", "share", "budget")
    met = _by_source(goal)(kept)
    here, end = F.struct("mix_key", "mix_mark", "mix_row"), F.struct("end_key", "end_mark", "end_row")
    some = F.col("end_key").isNotNull() & (F.col("mix_size") > 0)
    all_of_it = some & ((here < end) | (here == end) & (F.col("part") == F.col("mix_size")))
    epochs = F.when(F.col("mix_size") > 0, F.col("whole")).otherwise(0) + F.when(all_of_it, 1).otherwise(0)
    part = F.when(some & (here == end) & (F.col("part") < F.col("mix_size")), F.col("part")).otherwise(0)
    found = {"size": "mix_size", "source_size": "source_size", "target": "target", "epochs": "epochs", "part": "part", "taken": "taken"}
    met = met.withColumns({"epochs": epochs.cast("long"), "part": part.cast("long")}).withColumn("taken", F.col("epochs") * F.col("mix_size") + F.col("part"))
    return met.select(*[F.col(f"given.`{c}`").alias(c) for c in others], *[F.col(c).alias(fresh(rows, n)) for n, c in found.items()])


def write_out(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for each copy of a document, and the first words of a copy taken in part. ``mixed``: of :func:`mix`, with the text."""
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)))).where("copy > 0")
    # each piece is a word with the white space before it
    pieces = F.split(text_of(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return copies.withColumn(text, F.when(F.col("copy") > F.col("epochs"), F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col(text)))
