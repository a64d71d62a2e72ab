"""The operators of the llm subpackage against brute force, round trips and odd input."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from rodfield.llm import bpe, chat_format, jaccard_join, packing, quality, queries
from rodfield.llm.chunks import read_ranks
from rodfield.llm.embedding_dedup import _gaps, link
from rodfield.llm.fingerprint import add, compare_with_edits, fingerprint, subtract
from rodfield.llm.html_extract import extract, extract_main_text
from rodfield.llm.license_scan import license_digest, rules, scan_licenses
from rodfield.llm.line_dedup import dedup_lines
from rodfield.llm.quality import classify

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, "  \n\n "), (4, "one two"), (5, "cc by CC BY general public license"), (5, "cc by CC BY general public license"), (None, "no id here at all, none of it"), (7, "long " * 30000), (8, "é日本 x <|im_end|> %25")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1.0) for r in ODD], f"{SCHEMA}, score string, node double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents():
    return duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def test_packing(spark, odd, empty):
    assert packing.pack(empty, RANKS, P.PATTERN).count() == 0
    rows = packing.pack(odd, RANKS, P.PATTERN).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for part in by.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(r.length for r in rows if r.doc_id == 1) == 1


def test_packing_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = dict(documents())
    rows = packing.pack(spark.createDataFrame(list(docs.items()), SCHEMA), RANKS, P.PATTERN).collect()
    for doc, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_differencing_raises_the_window_count():
    parts = packing.divide([600, 600, 600])
    assert len(parts) == 3 and sorted(i for p in parts for i in p) == [0, 1, 2]


def test_bpe_matches_the_library(spark, odd, empty):
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    assert bpe.digest(empty, RANKS, P.PATTERN).count() == 0
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(odd, RANKS, P.PATTERN).collect()}
    want = set()
    for doc, text in ODD:
        ids = library.encode_ordinary(text or "")
        want.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    coder = bpe.BytePairCoder(read_ranks(RANKS), P.PATTERN)
    random.seed(2)
    texts = ["".join(random.choices("ab the日é \n\t!'s1", k=random.randint(0, 80))) for _ in range(500)]
    assert coder.encode(texts) == [library.encode_ordinary(t) for t in texts]


def _turned_pair():
    """Two words of 2048 letters, each the other's complement, that polynomial hashes modulo powers of two take for one."""
    word = [0]
    while len(word) < 2048:
        word += [1 - x for x in word]
    return ["".join("ab"[x ^ y] for x in word) for y in (0, 1)]


def test_texts_are_told_apart_by_their_bytes(spark):
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rows = [(i, f"x {w} y z u v") for i, w in enumerate(_turned_pair())]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = {i: np.array(library.encode_ordinary(t), "<u4") for i, t in rows}
    got = {r.doc_id: r for r in bpe.digest(df, RANKS, P.PATTERN).collect()}
    assert all(got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(rows[i][1].encode()).hexdigest() for i, ids in want.items())
    pieces = {}
    for r in packing.pack(df, RANKS, P.PATTERN).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, ids in want.items():
        whole = np.append(ids, np.uint32(0)).astype("<u4")
        assert all(r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in pieces[i]) and sum(r.length for r in pieces[i]) == len(whole)
    assert {(r.n_links, r.class_id) for r in jaccard_join.jaccard_join(df).collect()} == {(0, 0), (0, 1)}


def test_long_runs_merge_as_the_library_does():
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    coder = bpe.BytePairCoder(read_ranks(RANKS), P.PATTERN)
    random.seed(3)
    for n in (129, 513, 20_000):
        for letters in ("ab", "aéb", "abcdefghijklmnopqrstuvwxyz"):
            text = "".join(random.choices(letters, k=n))
            assert coder.encode([text]) == [library.encode_ordinary(text)]


def test_fingerprints(spark, odd, empty):
    assert compare_with_edits(empty).count() == 0
    rows = compare_with_edits(odd).collect()
    assert len(rows) == len(ODD)
    twins = [r for r in rows if r.doc_id == 5]
    assert twins[0].fingerprint == twins[1].fingerprint
    docs = sorted(documents(), reverse=True)
    got = {r.doc_id: r for r in compare_with_edits(spark.createDataFrame(docs, SCHEMA)).collect()}
    for (doc, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(text) // 3
        assert got[doc].edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.3


def test_likeness_by_plain_loops(spark):
    """Likenesses follow the share of word triples that two texts have in common."""
    docs = sorted((r for r in documents() if len(r[1].split()) > 60), reverse=True)[:80]

    def triples(text):
        out = []
        for line in text.split("\n"):
            w = [x for x in line.split(" ") if x]
            out += [tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        return Counter(out)

    def cosine(a, b):
        dot = sum(n * b[t] for t, n in a.items())
        return dot / np.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))

    got = {r.doc_id: r for r in compare_with_edits(spark.createDataFrame(docs, SCHEMA)).collect()}
    off = []
    for (doc, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        off += [got[doc].near_edited - cosine(triples(text), triples(edited)), got[doc].near_next - max(0.0, cosine(triples(text), triples(after)))]
    assert np.mean(np.abs(off)) < 0.1 and np.max(np.abs(off)) < 0.45


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([(1, "a b c d\ne f g", "h i j k", "h i j k\ne f g\na b c d")], "id long, one string, two string, both string")
    row = fingerprint(df, ["one", "two", "both"], ["id"]).select((add(F.col("one"), F.col("two")) == F.col("both")).alias("sum"), (subtract(F.col("both"), F.col("two")) == F.col("one")).alias("rest")).first()
    assert row["sum"] and row["rest"]


def test_chat_round_trip_and_layouts(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "100 %25 <%7C <|", "", None]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "a\nb%", None], said, strict=True))]
    df = chat_format.gather_rows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    out = chat_format.format_chat(df).withColumn("back", chat_format.read_back(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in out["back"]] == [(r or "", t or "") for (_, _, r, t) in rows]
    assert sum(m.chars for m in out["loss_mask"]) == len(out["formatted"])
    other = spark.createDataFrame([(1, "do", "this", "done")], "conv_id long, instruction string, input string, output string")
    assert [(t.role, t.text) for t in chat_format.canonical(other).first()["turns"]] == [("user", "do\n\nthis"), ("assistant", "done")]
    with pytest.raises(ValueError):
        chat_format.canonical(spark.createDataFrame([(1, 2)], "conv_id long, strange int"))
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_op4_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = con.execute(queries.OP4_SQL)
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, queries.op4_chat_formatting(spark, SF).select(*names).collect())) == sorted(cursor.fetchall())


def test_op4_null_conversations_and_turns(spark, tmp_path):
    rows = [(None, 0, "user", "a"), (None, None, "assistant", "b <|im_end|>"), (1, None, "assistant", None), (1, None, None, "%3C|"), (1, 2, "assistant", "x"), (1, 2, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(queries.OP4_SQL)
    names = [c[0] for c in cursor.description]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, queries.op4_chat_formatting(spark, str(tmp_path)).select(*names).collect()), key=key) == sorted(cursor.fetchall(), key=key)


def test_loss_mask_marks_what_is_told(spark):
    """A mask moved by one place gives another text: the digest is the mask's."""
    df = chat_format.gather_rows(spark.createDataFrame([(1, 0, "user", "q%"), (1, 1, "assistant", "a<|b%"), (1, 2, "assistant", "é")], "conv_id long, turn int, role string, text string"))
    out = chat_format.format_chat(df)
    moved = F.transform("loss_mask", lambda m, i: F.struct((m["chars"] + F.when(i == 0, 1).otherwise(0)).alias("chars"), m["loss"].alias("loss")))
    row = out.select(chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("right"), chat_format.masked_text(F.col("formatted"), moved).alias("wrong")).first()
    assert row["right"] == "a<|b%é" and row["wrong"] != row["right"]


def test_license_base_places(spark, odd, empty):
    assert len(rules()) > 200
    assert license_digest(scan_licenses(empty)).count() == 0
    docs = [*documents(), *[(10**6 + i, t) for i, (_, t) in enumerate(ODD)]]
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    got = {r.doc_id: r for r in license_digest(scan_licenses(spark.createDataFrame(docs, SCHEMA))).collect()}
    for doc, text in docs:
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        r = got[doc]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found})) and 0 <= r.score <= 1


def _samples(tree, most=24):
    """Strings that a parsed pattern matches: every branch and every optional part with and without."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "IN":
            parts = [chr(v) if str(o) == "LITERAL" else "7" if str(o) == "CATEGORY" else chr(v[0]) for o, v in arg]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, inner = arg
            one = _samples(inner, most)
            parts = ([x * max(low, 1) for x in one] if low else ["", *one])
        elif name == "SUBPATTERN":
            parts = _samples(arg[-1], most)
        elif name == "BRANCH":
            parts = [x for branch in arg[1] for x in _samples(branch, most)]
        elif name == "CATEGORY":
            parts = ["7"]
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in parts][:4 * most]
    return list(dict.fromkeys(out))[:most] if len(out) > most else list(dict.fromkeys(out))


def test_every_license_rule_fires(spark):
    #: Rules whose keyword speaks of the subject and stands elsewhere in the text.
    about = (" licen", " liab")
    rows = []
    for n, rule in enumerate(rules()):
        body = rule["regex"].removeprefix("(?<= )(?:").removesuffix(")(?= )")
        found = [x for x in _samples(re._parser.parse(body)) if re.fullmatch(body, x)]
        assert found, rule
        rows += [(n, x + rule["keyword"] if rule["keyword"] in about and rule["keyword"] not in f" {x}" else x) for x in found]
    held = {r.n: r.ok for r in _fires(spark, rows).groupBy("n").agg(F.min("ok").alias("ok")).collect()}
    assert [rules()[n] for n, ok in held.items() if not ok] == []
    got = scan_licenses(spark.createDataFrame([(1, "For noncommercial use only."), (2, "Unauthorised copying")], SCHEMA)).collect()
    assert [[d.label for d in r.detections] for r in sorted(got)] == [["non-commercial"], ["proprietary"]]


def _fires(spark, rows):
    """Whether the gate and the keyword let the rule's own text pass."""
    from rodfield.llm import license_scan

    keywords = F.array(*[F.lit(r["keyword"]) for r in rules()])
    words = license_scan._lower(license_scan.canonical_words(F.col("text")))
    df = spark.createDataFrame(rows, "n int, text string").withColumn("words", words)
    return df.withColumn("ok", F.rlike("words", F.lit(license_scan._gate())) & F.contains("words", F.get(keywords, "n")))


def test_license_labels_brute_force(spark):
    """Labels of all rules and their suppression, by plain loops."""
    documents_ = documents()[:60] + [(10**6, "Licensed under the Apache License, Version 2.0. GNU General Public License v3 or later; CC BY-SA 4.0 (creative commons attribution sharealike 4 0 international)"), (10**6 + 1, "All rights reserved. MIT License. Copyright (c) 2020 by x. Used with permission")]
    got = {r.doc_id: (r.labels, r.n_base) for r in license_digest(scan_licenses(spark.createDataFrame(documents_, SCHEMA))).collect()}
    for doc, text in documents_:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        line = " " + "".join(f"{w} " for w in words)
        hits = []
        for r in rules():
            if r["keyword"] in line:
                for m in re.finditer(r["regex"], line):
                    start = line[: m.start()].count(" ") - 1
                    hits.append((r["label"], r["priority"], r["base"], start, start + m[0].count(" ")))
        kept = [h for h in hits if h[2] or not any(g[3] <= h[3] and h[4] <= g[4] and not g[2] and (g[1] < h[1] or g[1] == h[1] and g[4] - g[3] > h[4] - h[3]) for g in hits)]
        assert got[doc] == (",".join(sorted({h[0] for h in kept})), sum(h[2] for h in kept)), doc


def _plain_runs(docs):
    """Per document the maximal runs of lines that occur before, by comparing all suffixes: {doc: ({places}, [(from, to, lines, copy_of)])}."""
    real = {d: [(i, x.strip(" \t\n\r\x0b\f")) for i, x in enumerate(re.split(r"(?<=\n)", t or "")) if x.strip(" \t\n\r\x0b\f")] for d, t in docs}
    first, out = {}, {}
    order = sorted(real, key=lambda d: (d is None, d))
    for doc in order:
        ls = real[doc]
        runs, end = [], 0
        for i in range(len(ls)):
            n = 0
            while i + n < len(ls) and first.get(tuple(x for _, x in ls[i : i + n + 1]), (doc, i)) != (doc, i):
                n += 1
            if n and i + n > end:
                runs.append((ls[i][0], ls[i + n - 1][0], n, first[tuple(x for _, x in ls[i : i + n])][0]))
            end = max(end, i + n)
            for m in range(1, len(ls) - i + 1):
                first.setdefault(tuple(x for _, x in ls[i : i + m]), (doc, i))
        out[doc] = ({p for a, b, _, _ in runs for p, _ in ls if a <= p <= b}, runs)
    return out


def _check_runs(got, docs):
    want = _plain_runs(docs)
    for doc, text in docs:
        r, (gone, runs) = got[doc], want[doc]
        assert [tuple(x) for x in r.runs] == runs, doc
        assert r.longest_run == max((x[2] for x in runs), default=0) and r.n_deleted == len(gone)
        assert r.text == (text if text is None else "".join(x for i, x in enumerate(re.split(r"(?<=\n)", text)) if i not in gone))


def test_line_dedup_brute_force(spark, odd, empty):
    assert dedup_lines(empty).count() == 0
    assert dedup_lines(odd).count() == len(ODD)
    docs = sorted(documents())
    _check_runs({r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}, docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_random_overlapping_runs(spark, seed):
    """Few kinds of lines, so that runs of many lengths overlap each other, within a document too."""
    random.seed(seed)
    parts = ["".join(f"{random.choice('abcdefg')}{random.randrange(seed * 3)}\n" for _ in range(random.choice([3, 9, 20]))) for _ in range(6)]
    docs = [(i, "".join(random.choice([random.choice(parts), f"{random.choice('abc')}\n", " \n", "".join(x + "\n" for x in random.choice(parts).split("\n")[: random.randrange(9)] if x)]) for _ in range(random.randrange(7)))) for i in range(45)]
    docs += [(100, "A\nB\nC\nD\n"), (101, "B\nC\nD\nE\n"), (102, "A\nB\nC\nD\nE\n"), (103, "A\nB\nC\nD\nE\n"), (104, "z\n" * 40), (105, None), (None, "B\nC\nD\nE\nA")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    _check_runs(got, docs)
    assert got[103].longest_run == 5 and got[103].runs[0].copy_of == 102 and got[104].longest_run == 39


def test_op7_deletes_every_repeated_run(spark, tmp_path):
    documents_ = [
        (1, "share this page\nfirst text\n\nread more\n"), (2, "share this page\nsecond text\n\nread more\nread more\n"),
        (3, "a\nb\nc\nthird\n"), (4, "x\na\n\nb\nc\n"), (5, None), (6, " read more \t\nlast"),
    ]
    columns = [(d, t, "en", "s", len(t or "")) for d, t in documents_]
    spark.createDataFrame(columns, f"{SCHEMA}, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), {}
    for doc, text in documents_:
        kept = []
        for line in re.split(r"(?<=\n)", text or ""):
            if not line.strip() or line.strip() not in seen:
                kept.append(line)
            seen.add(line.strip())
        want[doc] = None if text is None else "".join(kept)
    got = {r.doc_id: r.text for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want and got[2] == "second text\n\n" and got[4] == "x\n\n"
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == {d: t for d, t in want.items()}


def test_line_dedup_clashing_columns_and_hot_lines(spark):
    rows = [(i, f"one line of all\nown {i}\n", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc long")
    for name in ("mark", "place", "__gone", "__mark", "a", "n_lines"):
        df = df.withColumn(name, F.lit("x"))
    got = {r.doc_id: r.asDict() for r in dedup_lines(df).collect()}
    assert got[0]["text"] == rows[0][1] and all(got[i]["text"] == f"own {i}\n" and got[i]["doc"] == i and got[i]["__gone"] == "x" for i in range(1, 40))


def _jaccard(docs):
    sets = []
    for doc, text in docs:
        w = text.split()
        sets.append((doc, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    links = {d: 0 for d, _ in sets}
    least = {d: d for d, _ in sets}
    pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and len(x & y) >= 0.8 * len(x | y)]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in sets:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {d: (links[d], least[d]) for d in links}


@pytest.mark.parametrize(("small", "whole"), [(512, 4096), (4, 4096), (4, 0)])
def test_jaccard_join_brute_force(spark, monkeypatch, small, whole):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "WHOLE", whole)
    monkeypatch.setattr(jaccard_join, "BLOCK", small * 2)
    random.seed(4)
    base = [f"w{k}" for k in range(300)]
    near = [(1000 + i, " ".join([*base[: 10 * (i % 5)], f"new{i}", *base[10 * (i % 5) + 1 :]])) for i in range(20)]
    docs = [*documents()[:120], *near, (2000, "a b"), (2001, "a b"), (2002, "")]
    found = jaccard_join.jaccard_join(spark.createDataFrame(docs, SCHEMA))
    assert {r.doc_id: (r.n_links, r.class_id) for r in found.collect()} == _jaccard(docs)


def test_jaccard_join_odd_input(odd, empty):
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.jaccard_join(odd).count() == len(ODD)
    assert jaccard_join.runs_for(0.9999) >= 5


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[30:40] = x[0] + rng.normal(size=(10, 8)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[0].tolist()), (61, None), (62, [0.0] * 8), (63, [float("nan")] * 8), (64, [None] * 8)]
    got = {r.vec_id: r for r in link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = np.array([r[1] for r in rows[:61]])
    unit = good / np.linalg.norm(good, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(61)] == near.sum(1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(61, 65))
    assert got[60].component_id == 0 and not got[60].kept
    assert link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_ids_that_are_null_or_repeated(spark):
    rows = [(None, [1.0, 0.0]), (2, [0.999, 0.01]), (1, [0.0, 1.0]), (1, [0.7, 0.7]), (3, [0.7, 0.71])]
    got = link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got) == [(-1, 1, 2, False), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]
    clash = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "y")], "vec_id long, embedding array<double>, weight string").withColumn("component", F.lit(1))
    assert [r.n_links for r in link(clash).collect()] == [1, 1]


def test_html(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="/">menu</a></nav><!-- <p>no</p> --><div class="ad">buy</div><article><h1>Head</h1><p><b>One &amp; t</b>wo<br>three<p>four\n five<aside>side</aside><div class="comments">c</div></article><footer>foot</footer></body></html>'
    assert extract(page) == "Head One & two three four five"
    rows = [(i, f"http://h.example/{i}", page.replace("four", f"four{i}")) for i in range(6)] + [(7, None, None), (8, "odd", ""), (9, "http://h.example/9", page[:-60])]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head One & two three four3 five" and got[7] == got[8] == "" and got[9].startswith("Head One & two")
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _pages(spark, bodies):
    rows = [(i, f"http://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("hosts", [20_000, 0])
def test_html_keeps_every_slot(spark, monkeypatch, hosts):
    from rodfield.llm import html_extract

    monkeypatch.setattr(html_extract, "HOSTS", hosts)
    long = "word " * 40
    got = _pages(spark, [f"<div class=x>Our site</div><article><h1>Title {i}</h1><p>lead {i}</p><div class=body>{long}{i}</div></article>" for i in range(6)])
    assert got == {i: f"Title {i} lead {i} {long}{i}" for i in range(6)}
    got = _pages(spark, [f"<nav>menu</nav><section class=a>{long}{i}</section><section class=b>second {i}</section>" for i in range(6)])
    assert got == {i: f"{long}{i} second {i}" for i in range(6)}
    got = _pages(spark, [f"<article class=k>one {i}</article><article class=l>two {i}</article>" for i in range(2)])
    assert got == {i: f"one {i} two {i}" for i in range(2)}
    assert set(_pages(spark, [f"<h1>Head</h1><div class=body>{long}</div>"] * 4).values()) == {f"Head {long}".strip()}


def test_html_leaves_out_unmarked_boilerplate(spark):
    parts = [f"word{i} " * 30 for i in range(8)]
    page = "<div>Welcome to our site, read what is new</div><div>Sign in to continue</div>{}<div>Copyright Example Corp.</div>"
    for wrap in ("<div class=story><h1>Title {i}</h1><p>{t}</p></div>", "<h1>Title {i}</h1><p>{t}</p>"):
        got = _pages(spark, [page.format(wrap.format(i=i, t=t)) for i, t in enumerate(parts)])
        assert got == {i: f"Title {i} {t.strip()}" for i, t in enumerate(parts)}
    # copies of one article are not its host's template
    copies = [page.format(f"<h1>Title</h1><p>{parts[0]}</p>") for _ in range(8)]
    assert all(parts[0].strip() in t for t in _pages(spark, copies).values())
    mostly = [*copies[:5], *(page.format(f"<h1>Title {i}</h1><p>{t}</p>") for i, t in enumerate(parts[:3]))]
    assert all(f"{parts[max(0, i - 5)].strip()}" in t and "Welcome" not in t for i, t in _pages(spark, mostly).items())


def test_html_words_of_names_inside_an_article():
    page = "<article><p class='toolbar-history'>one</p><p class='skip-line'>two</p><p id='search-theory'>three</p><div class='comment-list'>no</div><p class='ad'>no</p></article>"
    assert extract(page) == "one two three"
    assert extract("<div class='page-header-layout'><h1>All</h1><p>of the page is here</p><div class='comments'>no</div></div>") == "All of the page is here"


def test_html_names_do_not_cut_an_article(spark):
    """Sections of an article whose class or id is any word that speaks of no article text, or has it as a part."""
    from rodfield.llm.html_extract import NOISE

    for shape in ("class='{}'", "id='{}-of-old'", "class='my_{} x'"):
        names = [shape.format(w) for w in sorted(NOISE)]
        for before, after in (("<div class='ad'>buy</div><article>", "</article><div class=comments>well said</div>"), ("<div class='story'>", "</div><div class='ad'>buy</div>")):
            pages, want = [], {}
            for i in range(6):
                parts = [(f"Part {k} of {i}", f"Own words {k} {i}.") for k in range(len(names))]
                pages.append(f"{before}<h1>Title {i}</h1>" + "".join(f"<section {n}><h2>{h}</h2><p>{p}</p></section>" for n, (h, p) in zip(names, parts, strict=True)) + after)
                want[i] = " ".join([f"Title {i}", *(x for part in parts for x in part)])
            assert _pages(spark, pages) == want


def test_html_explained_parts_of_an_article_go(spark):
    """Inside the article go what other pages have too, links, and records, if their name says so; readers' comments outside it."""
    parts = [
        "<section class='newsletter'><p>Get our letters.</p></section>", "<div class='related'><ul><li><a href=/{i}>Read {i}</a></li><li><a href=/x{i}>And {i}</a></li></ul></div>",
        "<div class='comments'>" + "<div class='comment'><b>Ann{i}</b> I say {i}</div>" * 2 + "</div>", "<section class='discussion'><p>The findings {i} are new.</p></section>",
        "<section class='related'><p>See work {i} by others.</p><ul><li><a href=/y>of {i}</a></li></ul></section>",
    ]
    html = "<article><h1>T {i}</h1><p>Text {i}</p>" + "".join(parts) + "</article><div class='comment-list'><p>Bob {i}</p></div>"
    got = _pages(spark, [html.format(i=i) for i in range(6)])
    assert got == {i: f"T {i} Text {i} The findings {i} are new. See work {i} by others. of {i}" for i in range(6)}


def test_html_ties_nulls_and_repeated_ids(spark):
    """Two containers that hold the same number of characters both stay; null and repeated ids are pages of their own."""
    bodies = [f"<section class=a>left {i}</section><section class=b>more {i}</section>" for i in range(4)]
    rows = [(None if i < 2 else 7, f"http://h.example/{i % 2}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)] + [(None, None, None)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == ["", *(f"left {i} more {i}" for i in range(4))]
    assert sorted(str(r.page_id) for r in got) == ["7", "7", "None", "None", "None"]


def test_html_generated_sites_brute_force(spark):
    """Sites with known articles: each has its own layout and boilerplate; extraction gives the articles whole."""
    random.seed(8)
    sentence = lambda k: " ".join("".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(k))
    rows, want = [], {}
    for site in range(6):
        top, side, end = sentence(6), [sentence(2) for _ in range(4)], sentence(7)
        body = random.choice(["<article>{}</article>", "<div class=content>{}</div>", "<section id=text><div>{}</div></section>", "<main>{}</main>"])
        for n in range(9):
            blocks = [sentence(random.randint(4, 60)) for _ in range(random.randint(2, 6))]
            inner = "".join(f"<p>{b} &amp; so</p>" for b in blocks)
            menu = "".join(f"<li><a href=/{k}>{k}</a></li>" for k in side)
            html = f"<html><head><title>x</title></head><body><div>{top}</div><ul>{menu}</ul>{body.format(inner)}<div class=sidebar>{sentence(5)}</div><div>{end}</div><footer>{sentence(4)}</footer></body></html>"
            rows.append((len(rows), f"https://site{site}.example/{n}", html))
            want[len(want)] = " ".join(f"{b} & so" for b in blocks)
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_articles_without_a_template():
    assert extract("<article class=a>one</article><article class=b>two</article>") == "one two"


def test_quality_held_out(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify(empty, none).count() == 0
    assert all(r.score == pytest.approx(0.5) for r in classify(odd.drop("score"), none).collect())
    random.seed(1)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() + ("$$$" if i % 4 == 0 else "") for _ in range(40)), int(i % 4 > 0)) for i in range(240)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, quality int")
    got = classify(df.drop("quality"), df.select("doc_id", "quality")).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95


def test_op9_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cursor = con.execute(queries.OP9_SQL)
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, queries.op9_embedding_near_dedup(spark, SF).select(*names).collect())) == sorted(cursor.fetchall())


def _score(text, weights, bias):
    """A document's score by plain loops over its words."""
    words, chunks = text.split(), text.split(" ") if text else []
    total = 0.0
    for word in words:
        total += float(np.mean(weights[quality.features([word])[0]].astype(float)))
    often = max((chunks.count(c) for c in set(chunks)), default=0)
    shape = quality.shape_words(np.array([len(chunks)]), np.array([len(set(chunks))]), np.array([often]))
    odds = total / max(1, len(words)) / 2 + float(weights[shape].mean()) / 2 + bias
    return 1 / (1 + np.exp(-odds))


def _given(rows):
    return [(d, t, "en", "s", len(t or "")) for d, t in rows]


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long"


def _cases():
    text = dict(documents())
    few = sorted(text)[:60]
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
    return [*((d, text[d]) for d in few), (10**6, None), (10**6 + 1, ""), (few[0], text[few[0]]), (10**6 + 2, text[few[1]]), (10**6 + 3, near), (10**6 + 4, near + "more"), (None, "a row without an id"), (10**6 + 5, "long " * 5000)]


def test_quality_by_plain_loops(spark, tmp_path):
    rows = _cases()
    docs = spark.createDataFrame(_given(rows), PIPELINE)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    got = sorted((str(r.doc_id), r.text or "", r.score) for r in classify(docs, labels).collect())
    want = sorted((str(d), t or "", _score(t or "", *model)) for d, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], abs=1e-5) for g, w in zip(got, want, strict=True))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted(w[:2] for w in want if w[2] >= 0.5)


def test_ngram_jaccard_stage_by_plain_loops(spark):
    rows = _cases()
    got = corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(_given(rows), PIPELINE), SF)
    distinct = list(dict.fromkeys(rows))
    found = _jaccard([(d, t or "") for d, t in distinct if d is not None])
    want = {(d, t) for d, t in distinct if d is None or found[d][1] == d}
    assert got.columns == corpus_pipeline.COLUMNS and sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(d), t or "") for d, t in want)


def test_packing_stage_by_plain_loops(spark):
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rows = [r for r in dict.fromkeys(_cases()) if r[0] is not None]
    pieces, sequences = {}, {}
    for r in corpus_pipeline.packing(spark, spark.createDataFrame(_given(rows), PIPELINE), SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, text in rows:
        ids = np.array([*library.encode_ordinary(text or ""), 0], "<u4")
        at = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert not pieces
    for part in sequences.values():
        ends = [0, *np.cumsum([r.length for r in sorted(part, key=lambda r: r.offset)]).tolist()]
        assert sorted(r.offset for r in part) == ends[:-1] and ends[-1] <= 1024


def test_pipeline_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], PIPELINE)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = os.path.join(tmp_path, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= kept
        kept = docs.count()
    pieces = corpus_pipeline.packing(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == kept


def test_gaps_are_never_too_small():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(40, 16))
    c[20:] = c[:20] + rng.normal(size=(20, 16)) * 1e-6
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    true = np.linalg.norm(c[:, None] - c[None], axis=2)
    assert (_gaps(c) >= true).all() and np.abs(_gaps(c) - true).max() < 2e-6


def test_embedding_lengths_of_several_kinds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4 + i % 3) * 0.3 + 1).tolist()) for i in range(90)]
    got = {r.vec_id: r.n_links for r in link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    assert [got[i] for i in range(90)] == [sum(len(u) == len(v) and i != j and u @ v >= 0.95 for j, v in enumerate(unit)) for i, u in enumerate(unit)]
