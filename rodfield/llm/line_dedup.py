"""Line dedup: repeated runs of lines by prefix doubling over line ids.

Every line has an id (a hash of its trimmed text). Suffixes of the sequences of line ids
are classed by their first 1, 2, 4, ... lines: in each round the class of a suffix at
depth 2k is made from its class at depth k and that of the suffix k lines further on, and
suffixes whose class has one member leave. What is left after a round are the intervals of
the suffix array whose longest common prefix is at least that deep; rounds go on until none
is left, so to the longest repeated run. Order inside an interval is by document, then
place: its least suffix is the first copy, all others are later copies.

For each later copy the length of its longest earlier copy follows: it is at least the deepest such depth and below twice that.
Suffixes agree in m lines, 2^k <= m < 2^(k+1), if they agree in the class of depth 2^k at their start and in that at m - 2^k lines
further on, so each length is found by halving the range; in a round a class is regrouped once for each length that is asked of it.
As the end of what a suffix repeats never moves back along a document, each round narrows the ranges of its neighbours, and in whole
copies of documents nothing is left to ask.

A maximal repeated run starts where that end moves on. Runs (of one line or more) are part of the result, and the lines that they
cover are deleted.

DataFrame functions only. Shuffles carry hashes and places; texts are shuffled once, to
meet the lines to delete. Rounds are cut by checkpoint() in the shared folder.

Defined results: a null text is empty and stays as it is; blank lines take part in no run,
part none, and stay; lines are compared without ASCII white space at their ends; copies
that overlap count; rows with equal id and text are one document and get the same result;
null ids come after all others; columns of the caller keep their names and values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodfield.llm._common import cut, fresh, stored, text_of

#: Where lines end (after the match of this pattern), and what counts as white space at a line's ends.
LINE_END, WHITE = r"(?<=\n)", " \t\n\r\x0b\f"
#: Parts into which a round divides a range of lengths.
PARTS = 8
#: Groups of this share of all rows or more are joined by broadcast; there are no more than 1 / LARGE of them.
LARGE = 1e-3


def lines_of(text: Column, line_end: str = LINE_END) -> Column:
    """The lines with what ends them, so that they put together are the text."""
    return F.split(text, line_end)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def line_table(df: DataFrame, key: str, text: str, line_end: str = LINE_END) -> DataFrame:
    """One row for each line that isn't blank: document (id and hash), number among these lines, place among all, two hashes."""
    body = text_of(text)
    numbered = F.transform(lines_of(body, line_end), lambda line, i: F.struct(i.alias("place"), _trimmed(line).alias("line")))
    rows = df.select(F.col(key).alias("doc"), F.xxhash64(body).alias("mark"), F.posexplode(F.filter(numbered, lambda x: x["line"] != "")).alias("pos", "x"))
    return rows.select("doc", "mark", "pos", F.col("x.place").alias("place"), F.xxhash64("x.line").alias("a"), F.hash("x.line").alias("b"))


def _met(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of repeated classes with ``first``, their class's first copy. ``groups``: (__a, __b, __n, first), a row for each class.
    Very large classes are broadcast; their rows are spread in the join with the others."""
    groups = cut(groups)
    share = (groups.agg(F.sum("__n")).first()[0] or 0) * LARGE
    large = F.broadcast(groups.where(F.col("__n") >= share).select(F.col("__a").alias("__la"), F.col("__b").alias("__lb"), F.col("first").alias("__lf")))
    found = rows.join(large, (F.col("a") == F.col("__la")) & (F.col("b") == F.col("__lb")), "left")
    one = F.col("__lf").isNull()
    found = found.withColumns({"__ka": F.when(one, F.col("a")).otherwise(F.xxhash64("doc", "mark", "pos")), "__kb": F.when(one, F.col("b"))})
    found = found.join(groups.where(F.col("__n") < share), (F.col("__ka") == F.col("__a")) & (F.col("__kb") == F.col("__b")), "left")
    return found.withColumn("first", F.coalesce("first", "__lf")).where("first is not null").select(*rows.columns, "first")


def _order() -> Column:
    return F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("mark").alias("mark"), F.col("pos").alias("pos"))


def suffix_intervals(df: DataFrame, key: str = "doc_id", text: str = "text", line_end: str = LINE_END) -> list[DataFrame]:
    """For depths 1, 2, 4, ...: the suffixes whose first lines, so many, are those of another suffix too. Columns: ``doc``, ``mark``,
    ``pos``, ``place`` and ``last`` (of the first and the last of these lines), the class (``a``, ``b``) and its first copy."""
    rows = cut(line_table(df, key, text, line_end)).withColumn("last", F.col("place"))
    levels: list[DataFrame] = []
    while True:
        size = 1 << len(levels)
        groups = rows.groupBy(F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.count("*").alias("__n"), F.min(_order()).alias("first")).where("__n > 1")
        met = _met(rows, groups)
        met = cut(met if levels else met.dropDuplicates(["doc", "mark", "pos"]))
        if met.isEmpty():
            return levels
        levels.append(met)
        ahead = Window.partitionBy("doc", "mark").orderBy("pos").rangeBetween(size, size)
        next_ = F.first(F.struct("a", "b", "last")).over(ahead)
        rows = met.withColumn("__next", next_).where("__next is not null")
        rows = rows.select("doc", "mark", "pos", "place", F.xxhash64("a", "__next.a").alias("a"), F.hash("b", "__next.b", "__next.a").alias("b"), F.col("__next.last").alias("last"))


def _narrowed(rows: DataFrame) -> DataFrame:
    """Ranges of ``end`` (from ``low`` to ``high``) narrowed by those of neighbours, as it never moves back inside a stretch."""
    here = Window.partitionBy("doc", "mark", "stretch").orderBy("pos")
    low, high = F.max("low").over(here.rowsBetween(Window.unboundedPreceding, 0)), F.min("high").over(here.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumns({"__low": low, "__high": high}).select(*[c for c in rows.columns if c not in ("low", "high")], F.col("__low").alias("low"), F.col("__high").alias("high"))


def _first_copies(asked: DataFrame, members: DataFrame) -> DataFrame:
    """For suffixes and lengths (``level``, ``a``, ``b``, ``doc``, ``mark``, ``pos``, ``m``) the first copy of these lines, if that is an earlier one:
    ``d0``, ``k0``, ``p0``, ``m0``, ``copy_of``. ``members``: the classes of all suffixes at all levels."""
    lengths = asked.select("level", "a", "b", "m").distinct()
    tails = members.select(F.col("level").alias("l2"), F.col("doc").alias("d2"), F.col("mark").alias("k2"), F.col("pos").alias("p2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    there = members.join(lengths, ["level", "a", "b"]).withColumn("at", F.expr("cast(pos + m - shiftleft(1, level) AS int)"))
    there = there.join(tails, F.col("doc").eqNullSafe(F.col("d2")) & F.expr("mark = k2 AND level = l2 AND at = p2"))
    same = ["level", "a", "b", "m", "a2", "b2"]
    there = stored(there.select(*same, "doc", "mark", "pos"))
    firsts = there.groupBy(*same).agg(F.min(_order()).alias("first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    found = there.join(firsts, same).where(_order() != F.col("first"))
    return found.select(F.col("doc").alias("d0"), F.col("mark").alias("k0"), F.col("pos").alias("p0"), F.col("m").alias("m0"), F.col("first.doc").alias("copy_of"))


def longest_copies(levels: list[DataFrame], members: DataFrame) -> DataFrame:
    """Every suffix that has an earlier copy of a line or more: ``doc``, ``mark``, ``pos``, ``place``, its deepest class (``level``, ``a``,
    ``b``) and the document of that class's first copy, ``stretch`` and ``end``, the number after the last line of its longest earlier copy."""
    later = [rows.where(_order() != F.col("first")).withColumn("level", F.lit(k)) for k, rows in enumerate(levels)]
    every = reduce(DataFrame.unionByName, later)
    rows = every.groupBy("doc", "mark", "pos").agg(F.max(F.struct("level", "place", "a", "b", F.col("first.doc").alias("copy_of"))).alias("s")).select("doc", "mark", "pos", "s.*")
    rows = rows.withColumn("stretch", F.col("pos") - F.row_number().over(Window.partitionBy("doc", "mark").orderBy("pos")))
    last = F.max("pos").over(Window.partitionBy("doc", "mark", "stretch")) + 1
    size = F.expr("shiftleft(1, level)")
    rows = stored(_narrowed(rows.withColumns({"low": F.col("pos") + size, "high": F.least(F.col("pos") + 2 * size - 1, last)})))
    ends = F.transform(F.sequence(F.lit(1), F.lit(PARTS - 1)), lambda i: (F.col("low") + F.ceil((F.col("high") - F.col("low")) * i / PARTS)).cast("int"))
    here = F.expr("doc <=> d0 AND mark = k0 AND pos = p0")
    while not (open_ := rows.where("low < high")).isEmpty():
        asked = open_.select("level", "a", "b", "doc", "mark", "pos", F.explode(F.array_distinct(ends)).alias("m")).withColumn("m", F.col("m") - F.col("pos"))
        found = _first_copies(asked, members).groupBy("d0", "k0", "p0").agg(F.max("m0").alias("m0"))
        met = rows.join(found, here, "left")
        reached = F.coalesce(F.col("pos") + F.col("m0"), F.col("low"))
        missed = F.array_min(F.filter(ends, lambda e: e > reached)) - 1
        met = met.withColumns({"__low": reached, "__high": F.when(F.col("low") < F.col("high"), F.coalesce(missed, F.col("high"))).otherwise(F.col("high"))})
        rows = stored(_narrowed(met.select(*[c for c in rows.columns if c not in ("low", "high")], F.col("__low").alias("low"), F.col("__high").alias("high"))))
    return rows.select("doc", "mark", "pos", "place", "level", "a", "b", "copy_of", "stretch", F.col("low").alias("end"))


def maximal_runs(levels: list[DataFrame]) -> DataFrame:
    """Maximal runs that occur before: ``doc``, ``mark``, places of their first and last line (``from``, ``to``), ``lines``, and the document
    of their first copy (``copy_of``)."""
    # nothing is asked about classes of single lines, whose lengths are known
    members = stored(reduce(DataFrame.unionByName, [rows.select(F.lit(k).alias("level"), "a", "b", "doc", "mark", "pos") for k, rows in enumerate(levels)]).where("level > 0"))
    rows = longest_copies(levels, members)
    before = F.lag("end").over(Window.partitionBy("doc", "mark", "stretch").orderBy("pos"))
    starts = stored(rows.withColumn("__before", before).where("__before is null or end > __before").withColumn("m", F.col("end") - F.col("pos")).drop("__before"))
    longer = _first_copies(starts.where("m > shiftleft(1, level)"), members).withColumnRenamed("copy_of", "__of")
    found = starts.join(longer, F.expr("doc <=> d0 AND mark = k0 AND pos = p0 AND m = m0"), "left").withColumn("copy_of", F.when(F.col("m0").isNull(), F.col("copy_of")).otherwise(F.col("__of")))
    ends = rows.select(F.col("doc").alias("d2"), F.col("mark").alias("k2"), F.col("pos").alias("p2"), F.col("place").alias("to"))
    found = found.join(ends, F.expr("doc <=> d2 AND mark = k2 AND end - 1 = p2"))
    return found.select("doc", "mark", F.col("place").alias("from"), "to", F.col("m").cast("long").alias("lines"), "copy_of")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", line_end: str = LINE_END) -> DataFrame:
    """All columns, the text without later copies of repeated runs, ``n_lines`` before, ``n_deleted``, ``longest_run``, the lines
    of the longest run of the text that occurs before (0 if there is none), and ``runs``, all its maximal ones: places of the first
    and last line, lines, and the document of the first copy."""
    levels = suffix_intervals(df, key, text, line_end)
    others = [c for c in df.columns if c not in ("n_lines", "n_deleted", "longest_run", "runs")]
    lines = lines_of(text_of(text), line_end)
    if not levels:
        kept = [F.col(f"`{c}`") for c in others]
        none = F.array().cast(f"array<struct<from:int,to:int,lines:bigint,copy_of:{df.schema[key].dataType.simpleString()}>>")
        return df.select(*kept, F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_deleted"), F.lit(0).cast("long").alias("longest_run"), none.alias("runs"))
    name = {n: fresh(df, n) for n in ("__mark", "__doc", "__of", "__runs")}
    gone = maximal_runs(levels).groupBy(F.col("doc").alias(name["__doc"]), F.col("mark").alias(name["__of"])).agg(
        F.array_sort(F.collect_set(F.struct("from", "to", "lines", "copy_of"))).alias(name["__runs"])
    )
    given = df.withColumn(name["__mark"], F.xxhash64(text_of(text)))
    met = given.join(gone, F.col(key).eqNullSafe(F.col(name["__doc"])) & (F.col(name["__mark"]) == F.col(name["__of"])), "left")

    def left(parts: Column) -> Column:
        """The text without the lines that go, and how many go. Blank lines between them stay."""
        places = F.sequence(F.lit(0), F.size(parts) - 1)
        covered = F.array_distinct(F.flatten(F.transform(name["__runs"], lambda r: F.sequence(r["from"], r["to"]))))
        out = F.array_except(covered, F.filter(places, lambda i: _trimmed(F.get(parts, i)) == ""))
        return F.struct(F.array_join(F.transform(F.array_except(places, out), lambda i: F.get(parts, i)), "").alias("text"), F.size(out).cast("long").alias("n"))

    some = F.col(name["__runs"]).isNotNull()
    result = fresh(met, "__left")
    met = met.withColumn(result, F.when(some, F.transform(F.array(lines), left)[0]))
    return met.select(
        *[F.when(some, F.col(f"{result}.text")).otherwise(F.col(c)).alias(c) if c == text else F.col(f"`{c}`") for c in others],
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.col(f"{result}.n"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(F.array_max(F.transform(name["__runs"], lambda r: r["lines"])), F.lit(0)).cast("long").alias("longest_run"),
        F.coalesce(name["__runs"], F.array().cast(met.schema[name["__runs"]].dataType)).alias("runs"),
    )
