"""Source mixing, whitening and fill-in-middle against plain versions and odd input."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rodfield.llm import mixing, queries, whitening
from rodfield.llm.boundary_set import BLOCK, BoundarySet, code_point_bounds
from rodfield.llm.fill_middle import fill_in_middle, restore
from rodfield.llm.whitening import integers, squares, whiten

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_sql(name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    return con.execute(queries.ORACLES[name])


@pytest.mark.parametrize("name", ["op11_source_mixing", "op13_fill_in_middle"])
def test_query_matches_its_sql(spark, name):
    found, want = queries.QUERIES[name](spark, SF), by_sql(name)
    assert found.columns == [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want.fetchall()))


# --- boundary sets


@pytest.mark.parametrize("density", [0.0001, 0.01, 0.06, 0.3, 0.7, 0.999, 1.0, "runs", "mixed"])
def test_select_is_the_sorted_place(density):
    random_ = np.random.default_rng(5)
    size = 3 * BLOCK + 77
    if density == "runs":
        mask = np.repeat(random_.random(size // 500 + 1) < 0.5, 500)[:size]
    elif density == "mixed":
        mask = np.concatenate([np.ones(BLOCK, bool), np.zeros(BLOCK, bool), random_.random(BLOCK) < 0.4, np.ones(77, bool)])
    else:
        mask = random_.random(size) < density
    places, found = np.flatnonzero(mask), BoundarySet(mask)
    assert len(found) == len(places)
    assert [found.select(k) for k in range(0, len(places), 37)] == places[::37].tolist()
    if density == "mixed":
        assert [c.kind for c in found.containers] == ["run", "bitmap", "run"]
    if density == 0.01:
        assert {c.kind for c in found.containers} == {"array"}


def test_code_points_of_every_width():
    text = "aé日𝄞" * 20000 + "x"
    data = text.encode()
    found = code_point_bounds(data)
    assert len(found) == len(text) + 1
    for k in (0, 1, 2, 3, 4, 50_001, 79_999, len(text)):
        assert data[: found.select(k)].decode() == text[:k]
    assert len(code_point_bounds(b"")) == 1


# --- fill in the middle


def plain_middle(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, "plain", n, None, None
    if h[3] % 100 < 20:
        return f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", "spm", n, a, b - a
    return f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "psm", n, a, b - a


def test_fill_in_middle_of_odd_texts(spark):
    pieces = ["<", "S>", "P", ">", "<<", "M>", "日", "é", "𝄞", " "]
    random_ = random.Random(3)
    rows = [(i, "".join(random_.choices(pieces, k=random_.randrange(12)))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "no id"), (None, "no id"), (902, "a"), (902, "a"), (903, "日" * 100_000 + "x" * 100_000), (904, "<P>"), (905, "\x00 \n")]
    df = spark.createDataFrame([(*r, "given", 1) for r in rows], "doc_id long, text string, output string, n int")
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "output", "n", "output_", "form", "n_", "prefix_chars", "middle_chars"]
    got = out.withColumn("read", restore(F.col("output_"), F.col("form"))).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted([(r.doc_id, r.text, r.output_, r.form, r.n_, r.prefix_chars, r.middle_chars) for r in got], key=key) == sorted([(i, t, *plain_middle(i, t)) for i, t in rows], key=key)
    assert all(r.read == (r.text or "") and r.output == "given" and r.n == 1 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_rates(spark):
    df = spark.createDataFrame([(i, "one two three") for i in range(300)], "doc_id long, text string")
    forms = {r.form: r["count"] for r in fill_in_middle(df, rate=100, suffix_first=100).groupBy("form").count().collect()}
    assert forms == {"spm": 300}
    assert fill_in_middle(df, seed=2).where("form = 'psm'").count() not in (0, 300)


# --- mixing


def plain_targets(sizes, most=3.0):
    """By repeated sharing out, as the rule says."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    goal, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[n] for n in open_)
        for n in open_:
            goal[n] += left * weight[n] / total
        left = 0.0
        for n in list(open_):
            if goal[n] > most * sizes[n]:
                left += goal[n] - most * sizes[n]
                goal[n] = most * sizes[n]
                open_.remove(n)
    return goal


def checked_mix(spark, rows, **options):
    """The mix of rows (id, text, source), checked against the rules."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(mixing.measured(df), **options)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "epochs", "part", "taken"]
    assert sorted((repr(r.doc_id), repr(r.text), repr(r.source)) for r in got) == sorted((repr(a), repr(b), repr(c)) for a, b, c in rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    goal = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source]) and r.taken <= 3 * r["size"]
        assert r.taken == r.epochs * r["size"] + r.part and 0 <= r.part <= r["size"]
        taken[r.source] += r.taken
    for source, n in taken.items():
        assert abs(n - goal[source]) <= 0.5 + 1e-6
        # in the order of keys whole copies come first, then one in part, then none more
        extra = sorted((key_of(r), r.taken - math.floor(goal[source] / sizes[source] + 1e-12) * r["size"] < r["size"]) for r in got if r.source == source and r["size"]) if sizes[source] else []
        assert [less for _, less in extra] == sorted(less for _, less in extra)
    return got


def key_of(r):
    words = WORD.findall(r.text or "")
    u = (int(hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}:{r.text or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / min(max(len(set(words)) / math.sqrt(max(len(words), 1)) / 5, 0.1), 1.0)


@pytest.mark.parametrize("bits", [14, 2])
def test_mix_of_uneven_sources(spark, monkeypatch, bits):
    if bits == 2:  # cells so wide that the last sort has much to do, and every table joined with salts
        monkeypatch.setattr(mixing, "BITS", 2)
        monkeypatch.setattr(mixing, "SOURCES", 0)
    random_ = random.Random(8)
    names = ["b", "a", "é", "", None, "z" * 50, "日"]
    rows = [(i, " ".join(random_.choices("alpha beta gamma delta 日本 x".split(), k=random_.choice([1, 5, 40, 300]))), random_.choices(names, [50, 20, 3, 1, 8, 4, 2])[0]) for i in range(500)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t\n", None), (1003, "word " * 30_000, "é"), (None, "no id", "a"), (None, "no id", "a"), (5000, "", "empty source"), (5001, None, "empty source")]
    rows += [(7, "same row", "b")] * 40
    rows += [(i, "vertical\x0btab and\x0cfeed\xa0no break", "b") for i in range(2000, 2010)]
    first = checked_mix(spark, rows)
    random_.shuffle(rows)
    again = checked_mix(spark, rows)
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_mix_of_few_rows(spark):
    assert mixing.mix(mixing.measured(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0
    assert [r.taken for r in checked_mix(spark, [(1, None, None), (2, "", "a")])] == [0, 0]
    assert [r.taken for r in checked_mix(spark, [(1, "one two three", None)])] == [3]


def test_mix_takes_better_documents_first(spark):
    rows = [(i, f"varied words number {i} stand in this text of some length and mean something new each time {i * 7}" if i % 2 else "again " * 20, s) for i in range(400) for s in ("a", "b")]
    got = [r for r in checked_mix(spark, rows) if r.source == "a"]
    share = [sum(r.epochs for r in got if r.doc_id % 2 == odd) / 200 for odd in (0, 1)]
    assert share[1] > share[0] + 0.2


def test_mix_with_clashing_names_and_a_given_weight(spark):
    df = spark.createDataFrame([(i, "a b c", "x", 7, float(i)) for i in range(20)], "doc_id long, text string, source string, target int, part double")
    out = mixing.mix(mixing.measured(df, weight=F.when(F.col("part") > 3, F.lit(None)).otherwise(F.lit(-1.0))))
    assert out.columns == ["doc_id", "text", "source", "target", "part", "size", "source_size", "target_", "epochs", "part_", "taken"]
    assert [r.target for r in out.collect()] == [7] * 20 and out.agg(F.sum("taken")).first()[0] == 60


def test_written_mix_has_the_words_taken(spark):
    rows = [(i, f" lead {i}\tsome  words\nhere " * (i % 7), "ab"[i % 5 == 0]) for i in range(60)]
    mixed = mixing.mix(mixing.measured(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    out = mixing.write_out(mixed).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == mixed.agg(F.sum("taken")).first()[0]
    texts = {i: t for i, t, _ in rows}
    assert all(texts[r.doc_id].startswith(r.text) for r in out)


# --- whitening


def plain_whitening(x, components=16):
    x = [[int(v) for v in row] for row in x]
    distinct = sorted(set(map(tuple, x)))
    n, size = len(distinct), len(x[0])
    sums = [sum(row[i] for row in distinct) for i in range(size)]
    centre = lambda rows: np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in rows])
    c = centre(distinct)
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviations, values[order], centre(x) @ vectors[:, order] / np.sqrt(values[order]), np.trace(v)


def check_whitening(got, ids, x, components=16):
    n, deviations, values, y, trace = plain_whitening(x, components)
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    k = len(by)
    assert sorted(by) == list(range(1, k + 1))
    for c in range(k):
        mine = [by[c + 1][i] for i in ids]
        assert [r.deviation for r in mine] == deviations and {r.n for r in mine} == {n}
        found = np.array([r.whitened for r in mine])
        sign = np.sign(found @ y[:, c])
        assert np.allclose(sign * found, y[:, c], atol=1e-8)
        assert mine[0].explained == pytest.approx(values[c] / trace, rel=1e-9) and mine[0].identity_error < 1e-9
    return k


@pytest.mark.parametrize("complete", [512, 4])
def test_whitening_by_eigenvectors(spark, monkeypatch, complete):
    if complete == 4:
        monkeypatch.setattr(whitening, "DIRECT", 0)
    random_ = np.random.default_rng(4)
    x = random_.standard_normal((300, 20)) * np.linspace(3, 0.2, 20) @ np.linalg.qr(random_.standard_normal((20, 20)))[0] + 5
    vectors = [list(map(float, r)) for r in x] + [list(map(float, x[0]))] * 30
    bad = [None, [], [None] * 20, [float("nan")] + [0.0] * 19, [float("inf")] + [0.0] * 19]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)] + [(1000 + i, v, 1) for i, v in enumerate(bad)], "vec_id long, embedding array<double>, n int").repartition(5)
    got = whiten(df, complete=complete).collect()
    assert check_whitening(got, range(330), np.floor(64 * np.array(vectors)) + 1_000_000) == 16


def test_op12_by_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], np.float64)) + 1_000_000
    assert check_whitening(queries.op12_embedding_whitening(spark, SF).collect(), [r.vec_id for r in rows], x) == 16


def test_whitening_of_few_directions_and_equal_deviations(spark):
    make = lambda rows: spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    line = [[float(i), 2.0 * i, 0.0, 1.0] for i in range(8)]
    got = whiten(make(line)).collect()
    assert {r.component for r in got} == {1} and check_whitening(got, range(8), np.floor(64 * np.array(line)) + 1_000_000) == 1
    # the deviations of six axes are all equal: any directions do, if what is whitened has the identity as its covariance
    axes = [[float(s * (i == k)) for i in range(6)] for k in range(6) for s in (-1, 1)]
    got = whiten(make(axes), components=4).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and all(r.identity_error < 1e-9 and abs(r.explained - 1 / 6) < 1e-9 for r in got)
    assert whiten(make([[1.0, 2.0]] * 5)).count() == 0 and whiten(make([])).count() == 0


def test_whitening_of_each_length_by_itself(spark):
    random_ = np.random.default_rng(6)
    short, long = random_.standard_normal((40, 3)), random_.standard_normal((50, 5))
    rows = [(i, list(map(float, v))) for i, v in enumerate(short)] + [(100 + i, list(map(float, v))) for i, v in enumerate(long)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    grid = lambda v: np.floor(64 * v) + 1_000_000
    assert check_whitening([r for r in got if r.vec_id < 100], range(40), grid(short)) == 3
    assert check_whitening([r for r in got if r.vec_id >= 100], range(100, 150), grid(long)) == 5


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3e9, 2.0]), (None, [0.0, 0.25]), (None, [0.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [r.x for r in integers(df).collect()]
    assert sorted(v[0] for v in x)[-1] == 64 * 2**40 + 1_000_000
    got = whiten(df)
    # the second direction's variance is below 1e-20 of the first's
    assert got.count() == 5 and got.where("vec_id is null").count() == 2
    assert squares(np.array([[1, 1 << 45]], np.int64), 3, [3, 5]) == [None]
    assert squares(np.array([[1, 4]], np.int64), 3, [3, 5]) == [49]
