"""HTML extraction by template deduction from equivalence classes.

A page is a sequence of tokens. A token is an element, known by its path of block elements
with class and id, or the text of a block, known by its path and words. Over the pages of a
host each token has an occurrence vector: how often it occurs on each page. Tokens with
equal vectors form an equivalence class. A class is valid if its tokens occur once a page
on at least half of the host's pages, and nests in the template if the parents of its
elements are in the template too. The valid classes, nested, are the host's template; what
lies between its tokens are slots.

The main slot is found by following, from the root, the container that holds most of the
text that is no menu, header, footer, sidebar, notice, advert, form, script, style or
comment. Texts of the template (on a host whose texts differ at all) are left out: outside
the main slot those of every valid class, inside it those on nearly all of the host's
pages, unless they are most of a page's text there, as on a host of copies. All else that
the slots hold is extracted, in page order.

Elements that hold no article text are told by their tags. A word of a class or id tells so only
outside the main slot: of a container by a part of the name, of a paragraph, heading or the
like by the whole name, and never of an element around the main slot. Inside the main
slot a name drops nothing by itself: such an element goes if the template explains all that it holds on the page, as texts
that other pages of the host have too, as links, or as records (elements with a class that some page has several of, like readers'
comments). On a page without a template of its host (its only page, or :func:`extract` alone) nothing can be explained and
names decide everywhere, save for an element that holds most of the page's text and its article or heading.

Vectors are never collected: a class is told by sums of hashes of page and count, added
up per task and then per host, so a host with a third of all pages costs no more than
others. A host with one page has nothing to compare it with, and uses the containers of all pages' template. Pages meet their host's
template through a broadcast where the number of hosts is at most ``HOSTS``, else
through a join with a salted host.

Defined results: a null page is empty; an empty page, or one without text in its
slots, gives the empty text; a null or odd url is the host ""; repeated rows give repeated
results; cut-off pages are read as far as they go; an unclosed comment hides the rest.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodfield.llm._common import cut

#: Least pages of a host with a template of its own, share of pages that a token must be on, share of them with just one,
#: share of the text that the next container must hold, most hosts that are broadcast, salts of the join beyond.
PAGES, SUPPORT, ONCE, HOLD, HOSTS, SALTS = 2, 0.5, 0.9, 0.6, 20_000, 64
#: Share of a host's pages that a text of the template inside the main slot is on, and share of a page's text there that such texts stay below.
NEARLY_ALL, MOST = 0.9, 0.5

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold no article text, whatever their class.
ASIDE = set("head nav header footer aside form script style noscript template svg math iframe object select textarea button canvas video audio dialog menu".split())
RAW = "script|style|textarea|noscript|template|svg|iframe"
#: Elements whose start ends an open paragraph.
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table"}
#: Containers that the search for the main slot may enter.
CONTAINERS = set("html body main article section div td table tbody tr center".split())
#: Containers that are no slot by themselves, and elements that may be records of a list.
OUTER, RECORDS = set("html body center".split()), set("div section article li tr td dd blockquote".split())
#: Words of classes and ids of elements that hold no article text.
NOISE = set("""ad ads adv advert adverts advertisement advertising banner banners promo promotion sponsor sponsored nav navbar navigation menu menus breadcrumb
breadcrumbs sidebar footer header masthead comment comments disqus discussion reply replies cookie cookies consent notice notices gdpr newsletter subscribe
subscription share sharing social related recommended popup modal overlay login signup search widget widgets pagination pager toolbar skip""".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(?P<name2>/?[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _label(name: str, rest: str) -> tuple[str, bool]:
    """An element's token, and whether a word of its class or id speaks of no article text."""
    words: list[str] = []
    if rest and "=" in rest:
        for m in _NAMES.finditer(rest):
            words += (m[1] or m[2] or m[3] or "").lower().split()
    label = name + "".join(f".{re.sub(r'[0-9]+', '0', w)}" for w in words)
    return label, bool(words) and _noise(name, ".".join(words))


def _noise(name: str, names: str) -> bool:
    """Whether a word of an element's class or id speaks of no article text."""
    words = names.split(".")
    return any(p in NOISE for w in words for p in re.split(r"[-_]+", w)) if name in CONTAINERS or name in LISTS else any(w in NOISE for w in words)


def _noisy(step: str) -> bool:
    """Whether a step of a path is an element whose name speaks of no article text."""
    name, _, names = step.partition(".")
    return bool(names) and _noise(name, names)


class Block(NamedTuple):
    """A block of text: its path, whether it is in an element without article text by its tag, the paths of elements above it that
    are so by their name, whether all of it is in links, and its text."""

    path: str
    hidden: bool
    named: tuple[str, ...]
    links: bool
    text: str


def read(html: str) -> tuple[list[Block], Counter]:
    """Blocks of text in page order, and how often each path opens."""
    blocks: list[Block] = []
    opened: Counter = Counter()
    stack: list[tuple[str, str, bool, tuple[str, ...]]] = []  # name, path, hidden, named
    parts: list[str] = []
    links = 0
    plain = False

    def end_block() -> None:
        nonlocal plain
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                _, path, hidden, named = stack[-1] if stack else ("", "", False, ())
                blocks.append(Block(path, hidden, named, not plain, text))
            parts.clear()
        plain = False

    def pop(names: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
            plain = plain or not links
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if m["close"] else 1))
            continue
        end_block()
        if m["close"]:
            pop({name}, set() if name not in ENDS_SAME and name != "p" else LISTS if name != "p" else CONTAINERS)
            continue
        if name in ENDS_P:
            pop({"p"}, CONTAINERS - {"html", "body"} | LISTS | {"li", "blockquote"})
        if name in ENDS_SAME:
            pop(ENDS_SAME[name], LISTS)
        if name == "body" and stack and stack[-1][0] == "head":
            stack.pop()
        label, noise = _label(name, m["rest"] or "")
        _, above, hidden, named = stack[-1] if stack else ("", "", False, ())
        path = f"{above}/{label}"
        opened[path] += 1
        if name not in VOID and not (m["rest"] or "").endswith("/"):
            stack.append((name, path, hidden or name in ASIDE, (*named, path) if noise else named))
    if at < len(html):
        parts.append(html[at:])
        plain = plain or not links
    end_block()
    return blocks, opened


def _ancestors(path: str) -> list[str]:
    steps = path.split("/")[1:]
    return ["/" + "/".join(steps[: k + 1]) for k in range(len(steps))]


def with_text(blocks: list[Block], opened: Counter) -> list[Block]:
    """Blocks that may hold article text. A name speaks of no article text in vain where the element holds most of the page's text
    and an article or its heading."""
    left = [b for b in blocks if not b.hidden]
    if not any(b.named for b in left):
        return left
    held: Counter = Counter()
    for b in left:
        for p in b.named:
            held[p] += len(b.text)
    most = HOLD * sum(len(b.text) for b in left)
    heads = [p for p in opened if p.rpartition("/")[2].split(".")[0] in ("article", "main", "h1")]
    vain = {p for p, n in held.items() if n > most and any(h.startswith(f"{p}/") for h in heads)}
    return [b for b in left if vain.issuperset(b.named)]


def main_slots(opened: Counter, container: str | None) -> list[str]:
    """Paths of the main slot on a page: the template's container if the page has it, else its articles, else its mains."""
    if container and container in opened:
        return [container]
    tags = {p: p.rpartition("/")[2].split(".")[0] for p in opened}
    return next((found for t in ("article", "main") if (found := [p for p in opened if tags[p] == t])), [])


def without_explained(blocks: list[Block], opened: Counter, slots: list[str], texts: frozenset[int], records: frozenset[str]) -> list[Block]:
    """Blocks that may hold article text on a page of a host with a template: outside the main slot names decide; inside it an element
    with such a name goes if all its blocks are texts of the template, links or records."""
    left = [b for b in blocks if not b.hidden]
    slots = [p for p in slots if p.rpartition("/")[2].split(".")[0] not in OUTER]
    if not slots:
        return with_text(blocks, opened)

    def inner(p: str) -> bool:
        return any(p.startswith(f"{s}/") for s in slots)

    def around(p: str) -> bool:
        return any(f"{s}/".startswith(f"{p}/") for s in slots)

    open_: set[str] = set()
    for b in left:
        inside = [p for p in b.named if inner(p)]
        if inside and not (b.links or text_token(b) in texts or any(a in records for a in _ancestors(b.path))):
            open_.update(inside)
    return [b for b in left if not any(not around(p) and not (inner(p) and p in open_) for p in b.named)]


def text_token(block: Block) -> int:
    """The token of a block's text."""
    return int.from_bytes(hashlib.blake2b(f"{block.path}\n{block.text}".encode("utf-8", "surrogatepass"), digest_size=8).digest()) >> 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token (a path; or, with ``token``, a text): pages, pages where it occurs once, the sum that tells the
    occurrence vector, characters of text."""
    names = ["host", "path", "token", "pages", "once", "vector", "chars"]
    held: dict[tuple[str, str, int | None], list[int]] = {}

    def out() -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        kinds = (pa.string(), pa.string(), pa.int64())
        made = [*(pa.array([k[n] for k in keys], kinds[n]) for n in range(3)), *(pa.array([v[n] for v in values], pa.int64()) for n in range(4))]
        held.clear()
        return pa.RecordBatch.from_arrays(made, names)

    for batch in batches:
        for host, page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks, opened = read(html or "")
            chars: Counter = Counter()
            texts: Counter = Counter()
            shown = [b for b in blocks if not b.hidden]
            for b in shown:
                for a in _ancestors(b.path):
                    chars[a] += len(b.text)
                t = text_token(b)
                texts[t] += 1
                chars[t] += len(b.text)
            tokens = [("", None, 1, sum(len(b.text) for b in shown)), *((p, None, n, chars[p]) for p, n in opened.items()), *(("", t, n, chars[t]) for t, n in texts.items())]
            marks = {n: zlib.crc32(f"{page} {n}".encode()) for n in {n for _, _, n, _ in tokens}}
            for h in (host, "*"):
                for path, token, n, size in tokens:
                    # texts that all hosts share are no host's template
                    if token is None or h != "*":
                        row = held.setdefault((h, path, token), [0, 0, 0, 0])
                        row[0] += 1
                        row[1] += n == 1
                        row[2] += marks[n]
                        row[3] += size
            if len(held) > 100_000:
                yield out()
    if held:
        yield out()


def token_table(pages: DataFrame) -> DataFrame:
    """All tokens of every host, as ``_count`` has them, with the host's number of pages and of characters. Texts on one page
    only are left out."""
    rows = pages.select("host", F.col("page").cast("string"), "html").mapInArrow(_count, "host string, path string, token long, pages long, once long, vector long, chars long")
    tokens = cut(rows.groupBy("host", "path", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "once", "vector", "chars")]).where("token is null or pages > 1"))
    hosts = tokens.where("path = '' and token is null").select("host", F.col("pages").alias("all"), F.col("chars").alias("of"))
    return tokens.join(hosts, "host")


def occurrence_classes(tokens: DataFrame) -> DataFrame:
    """Valid tokens of every host, and how many tokens share the vector of each."""
    valid = tokens.where("path != '' or token is not null").where((F.col("pages") >= SUPPORT * F.col("all")) & (F.col("once") >= ONCE * F.col("pages")) & ((F.col("all") >= PAGES) | (F.col("host") == "*")))
    sizes = valid.groupBy("host", "vector", "pages").agg(F.count("*").alias("tokens"))
    return valid.join(sizes, ["host", "vector", "pages"])


def template_texts(valid: DataFrame) -> DataFrame:
    """Per host the texts of its template: those on nearly all pages and the others. A host whose texts are all on nearly all of its
    pages has none."""
    nearly = F.col("pages") >= NEARLY_ALL * F.col("all")
    found = valid.where("token is not null").groupBy("host").agg(
        F.collect_list(F.when(nearly, F.col("token"))).alias("everywhere"), F.collect_list(F.when(~nearly, F.col("token"))).alias("often"), (F.coalesce(F.sum(F.when(nearly, F.col("chars"))), F.lit(0)) < F.first("of")).alias("differ")
    )
    return found.where("differ").select("host", "everywhere", "often")


def record_paths(tokens: DataFrame) -> DataFrame:
    """Per host the paths of elements with a class that some page has several of, inside an element whose name speaks of no article text."""
    @F.udf("boolean")
    def record(path):
        steps = path.split("/")[1:]
        tag, _, names = steps[-1].partition(".")
        return bool(names) and tag in RECORDS and any(_noisy(x) for x in steps[:-1])

    several = tokens.where((F.col("host") != "*") & F.col("token").isNull() & (F.col("once") < F.col("pages")) & F.col("path").contains("."))
    return several.where(record("path")).groupBy("host").agg(F.collect_list("path").alias("records"))


def main_container(tokens: pd.DataFrame) -> str | None:
    """The path of the main slot's container in a template, given its valid tokens."""
    rows = {r.path: r for r in tokens.itertuples()}
    template: set[str] = set()
    # classes from the largest on; those that don't nest in what is there are left out
    for _, members in sorted(tokens.groupby(["vector", "pages"]), key=lambda x: (-len(x[1]), -x[0][1])):
        nested = set(members["path"])
        if all(p.rpartition("/")[0] in template | nested | {""} for p in nested):
            template |= nested
    heads = [p for p in template if p.rpartition("/")[2].split(".")[0] in ("article", "main", "h1")]
    at = ""
    while True:
        below = [p for p in template if p.rpartition("/")[0] == at and p.rpartition("/")[2].split(".")[0] in CONTAINERS]
        # elements whose name speaks of no article text are passed by, unless they have the article or its heading
        named = {p for p in below if _noisy(p.rpartition("/")[2]) and not any(h.startswith(f"{p}/") for h in heads)}
        total = (rows[at].chars if at else sum(rows[p].chars for p in below)) - sum(rows[p].chars for p in named)
        below = [p for p in below if p not in named]
        best = max(below, key=lambda p: (rows[p].chars, p), default=None)
        if best is None or total == 0 or rows[best].chars < HOLD * total:
            return at or None
        at = best


def extract(html: str, container: str | None = None, everywhere: frozenset[int] = frozenset(), often: frozenset[int] = frozenset(), records: frozenset[str] = frozenset(), known: bool = False) -> str:
    """The text of all slots. ``everywhere`` and ``often``: texts of the host's template, ``records``: paths of its records; ``known``:
    whether the host has a template."""
    blocks, opened = read(html)
    slots = main_slots(opened, container)
    left = without_explained(blocks, opened, slots, everywhere | often, records) if known else with_text(blocks, opened)
    if not everywhere and not often:
        return " ".join(b.text for b in left)
    inside = [any(b.path == h or b.path.startswith(f"{h}/") for h in slots) or not slots for b in left]
    tokens = [text_token(b) for b in left]
    template = [t in everywhere or t in often and not i for t, i in zip(tokens, inside, strict=True)]
    taken, total = (sum(len(b.text) for b, i, t in zip(left, inside, template, strict=True) if i and (t or whole)) for whole in (False, True))
    if taken >= MOST * total:
        template = [t and not i for t, i in zip(template, inside, strict=True)]
    return " ".join(b.text for b, t in zip(left, template, strict=True) if not t)


@lru_cache(maxsize=4096)
def _template(text: str) -> tuple[str | None, frozenset[int], frozenset[int], frozenset[str], bool]:
    t = json.loads(text)
    return t.get("container"), *(frozenset(t.get(name) or ()) for name in ("everywhere", "often", "records")), t.get("host", "*") != "*"


def extract_main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The key, the url and the main ``text`` of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    pages = df.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host.alias("host"))
    tokens = token_table(pages)
    valid = occurrence_classes(tokens)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        found = main_container(group)
        return pd.DataFrame({"host": group["host"].iloc[:1], "container": [found]})

    containers = valid.where("token is null").groupBy("host").applyInPandas(choose, "host string, container string")
    whole = containers.join(template_texts(valid), "host", "full").join(record_paths(tokens), "host", "left")
    templates = cut(whole.select("host", F.to_json(F.struct("host", "container", "everywhere", "often", "records")).alias("template")))
    shared = templates.where("host = '*'").first()
    fallback = shared["template"] if shared else "{}"
    schema = f"{key} {df.schema[key].dataType.simpleString()}, url {df.schema[url].dataType.simpleString()}, text string"
    if templates.count() <= HOSTS:
        known = {r["host"]: r["template"] for r in templates.collect()}
        sent = df.sparkSession.sparkContext.broadcast(known)
        met = pages.select("page", "url", "html", "host")
    else:
        sent = None
        salts = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = pages.withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"], "left").select("page", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(3).to_pylist()
            chosen = [sent.value.get(h) for h in hosts] if sent else batch.column(4).to_pylist()
            found = [_template(c or fallback) for c in chosen]
            texts = [extract(x or "", *t) for x, t in zip(batch.column(2).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [key, "url", "text"])

    return met.mapInArrow(run, schema)
