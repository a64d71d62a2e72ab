"""License scans by ordered signature rules.

A text is brought to a canonical form (lower-case A-Z, words separated by one space).
Hundreds of regexes over that form, each with a keyword that must occur before the
regex is tried, yield detections with a priority and an interval of words. A detection
that lies inside the interval of another label's detection of better priority, or of
the same priority and a longer interval, is suppressed. Base detections always stay.

The scan is one pass over the table: no shuffle, no Python. Rules are literals of the
plan; a text that holds no keyword costs one regex. Everything is a Column expression.

Defined results: a null text is empty; an empty text has no words, no detections and
score 0; the length of a text is not limited; repeated rows give repeated results.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rodfield.llm._common import text_of

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_VERSION = r"(?: (?:version|v|ver))?"
_LIC = r"licen[cs]e"


def _creative_commons() -> list[tuple[str, str, str, int]]:
    kinds = {
        "by": ("by", "attribution"), "by-sa": ("by sa", "attribution share ?alike"), "by-nd": ("by nd", "attribution no ?deriv(?:ative)?s?"),
        "by-nc": ("by nc", "attribution non ?commercial"), "by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
        "by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
    }
    rules = []
    for kind, (short, long) in kinds.items():
        rules.append((f"cc-{kind}", " cc ", rf"cc {short}", 40))
        rules.append((f"cc-{kind}", "creative commons", rf"creative commons {long}(?: international)?(?: public)?(?: {_LIC})?", 40))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            rules.append((label, " cc ", rf"cc {short} {version}", 30))
            rules.append((label, "creative commons", rf"creative commons {long} {version}(?: international| unported| generic)?(?: public)?(?: {_LIC})?", 30))
            rules.append((label, "creativecommons", rf"creativecommons org licenses {short} {version}", 20))
    rules.append(("cc0-1.0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?", 30))
    rules.append(("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 20))
    rules.append(("cc-mark", "creativecommons", r"creativecommons org publicdomain mark 1 0", 20))
    rules.append(("cc", "creative commons", r"creative commons(?: public)?(?: licen[cs]es?)?", 60))
    return rules


def _gnu() -> list[tuple[str, str, str, int]]:
    families = {
        "gpl": ("gpl", r"(?:gnu )?general public licen[cs]e", ("1", "2", "3")),
        "lgpl": ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2", "2 1", "3")),
        "agpl": ("agpl", r"(?:gnu )?affero general public licen[cs]e", ("1", "3")),
        "gfdl": ("gfdl", r"(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    }
    rules = []
    for label, (short, long, versions) in families.items():
        keyword = "documentation" if label == "gfdl" else "general public"
        rules.append((label, f" {short} ", rf"(?:gnu )?{short}", 60))
        rules.append((label, keyword, long, 50))
        for version in versions:
            v = version if " " in version else rf"{version}(?: 0)?"
            name = f"{label}-{version.replace(' ', '.')}"
            rules.append((name, f" {short}", rf"(?:gnu )?{short}(?: version| v)? ?{v}", 40))
            rules.append((name, f" {short}v", rf"{short}v{v}", 40))
            rules.append((name, keyword, rf"{long}{_VERSION} v?{v}", 35))
            rules.append((f"{name}-only", keyword, rf"{long}{_VERSION} v?{v} only", 30))
            rules.append((f"{name}-or-later", keyword, rf"{long}{_VERSION} v?{v} or (?:at your option )?(?:any )?later(?: version)?", 30))
            rules.append((f"{name}-only", f" {short} ", rf"{short} {v} only", 25))
            rules.append((f"{name}-or-later", f" {short} ", rf"{short} {v} or later", 25))
    return rules


def _named() -> list[tuple[str, str, str, int]]:
    """Licenses that carry a name, with their versions where they have any."""
    versioned = {
        "apache": ("apache", r"apache(?: software)?(?: licen[cs]e)?", ("1 0", "1 1", "2 0")),
        "mpl": ("mozilla", r"mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
        "epl": ("eclipse", r"eclipse public licen[cs]e", ("1 0", "2 0")),
        "edl": ("eclipse", r"eclipse distribution licen[cs]e", ("1 0",)),
        "eupl": ("european union", r"european union public licen[cs]e", ("1 0", "1 1", "1 2")),
        "cddl": ("development and distribution", r"common development and distribution licen[cs]e", ("1 0", "1 1")),
        "cpl": ("common public", r"common public licen[cs]e", ("1 0",)),
        "osl": ("open software", r"open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
        "afl": ("academic free", r"academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
        "artistic": ("artistic", r"artistic licen[cs]e", ("1 0", "2 0")),
        "bsl": ("boost", r"boost software licen[cs]e", ("1 0",)),
        "ofl": ("open font", r"(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
        "lppl": ("latex", r"latex project public licen[cs]e", ("1 0", "1 1", "1 2", "1 3")),
        "zpl": ("zope", r"zope public licen[cs]e", ("1 1", "2 0", "2 1")),
        "psf": ("python", r"python(?: software foundation)? licen[cs]e", ("2 0",)),
        "php": ("php", r"php licen[cs]e", ("3 0", "3 01")),
        "ecl": ("educational community", r"educational community licen[cs]e", ("1 0", "2 0")),
        "odbl": ("open database", r"open database licen[cs]e", ("1 0",)),
        "odc-by": ("open data commons", r"open data commons attribution licen[cs]e", ("1 0",)),
        "pddl": ("public domain dedication", r"public domain dedication and licen[cs]e", ("1 0",)),
        "cecill": ("cecill", r"cecill(?: free software licen[cs]e agreement)?", ("1 0", "1 1", "2 0", "2 1")),
        "ms-pl": ("microsoft public", r"microsoft public licen[cs]e", ()),
        "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal licen[cs]e", ()),
        "qpl": ("q public", r"q public licen[cs]e", ("1 0",)),
        "ipl": ("ibm public", r"ibm public licen[cs]e", ("1 0",)),
        "spl": ("sun public", r"sun public licen[cs]e", ("1 0",)),
        "npl": ("netscape public", r"netscape public licen[cs]e", ("1 0", "1 1")),
        "rpl": ("reciprocal public", r"reciprocal public licen[cs]e", ("1 1", "1 5")),
        "cpal": ("common public attribution", r"common public attribution licen[cs]e", ("1 0",)),
        "elastic": ("elastic", r"elastic licen[cs]e", ("1 0", "2 0")),
        "sspl": ("server side public", r"server side public licen[cs]e", ("1",)),
        "busl": ("business source", r"business source licen[cs]e", ("1 0", "1 1")),
        "openrail": ("openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", ("1 0",)),
        "mulan": ("mulan", r"mulan(?: permissive software| psl| public)? licen[cs]e", ("1", "2")),
        "upl": ("universal permissive", r"universal permissive licen[cs]e", ("1 0",)),
        "blueoak": ("blue oak", r"blue oak model licen[cs]e", ("1 0 0",)),
        "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ()),
        "w3c": ("w3c", r"w3c software(?: notice and)? licen[cs]e", ()),
        "openssl": ("openssl", r"openssl licen[cs]e", ()),
        "unlicense": ("unlicense", r"(?:the )?unlicense", ()),
        "wtfpl": ("wtfpl", r"wtfpl(?: version 2)?", ()),
        "zlib": ("zlib", r"zlib(?: libpng)? licen[cs]e", ()),
        "isc": (" isc ", r"isc licen[cs]e", ()),
        "mit": ("mit licen", r"(?:the )?mit licen[cs]e", ()),
        "x11": (" x11 ", r"x11 licen[cs]e", ()),
        "vim": ("vim", r"vim licen[cs]e", ()),
        "ruby": ("ruby", r"ruby licen[cs]e", ()),
        "postgresql": ("postgresql", r"postgresql licen[cs]e", ()),
        "json": ("json", r"json licen[cs]e", ()),
        "beerware": ("beerware", r"beerware(?: licen[cs]e)?", ()),
        "bsd-0-clause": ("bsd", r"(?:0|zero) clause bsd(?: licen[cs]e)?", ()),
        "bsd-2-clause": ("bsd", r"(?:(?:2|two) clause|simplified|freebsd) bsd(?: licen[cs]e)?", ()),
        "bsd-3-clause": ("bsd", r"(?:(?:3|three) clause|new|revised|modified) bsd(?: licen[cs]e)?", ()),
        "bsd-4-clause": ("bsd", r"(?:(?:4|four) clause|original|old) bsd(?: licen[cs]e)?", ()),
        "bsd": ("bsd", r"bsd(?: style)? licen[cs]e", ()),
    }
    rules = []
    for label, (keyword, name, versions) in versioned.items():
        rules.append((label, keyword, name, 50))
        for version in versions:
            rules.append((f"{label}-{version.replace(' ', '.')}", keyword, rf"{name}(?: agreement)?{_VERSION} v?{version}", 40))
        if versions:
            rules.append((f"{label}-or-later", keyword, rf"{name}{_VERSION} v?{versions[0].split(' ')[0]}[ 0-9]* or (?:any )?later(?: version)?", 35))
    return rules


def _notices() -> list[tuple[str, str, str, int]]:
    """Wording that says how a text may be used without naming a license."""
    wording = {
        "copyright": [("copyright", r"copyright(?: c)? \d{4}(?: \d{4})*", 70), ("copyright", r"copyright(?: c)? by", 75), ("copyright", r"copyright notice", 80), ("copyrighted", r"copyrighted(?: material| work)?", 80), ("copyright", r"(?:protected|covered) by copyright(?: law)?", 75)],
        "reserved": [("rights reserved", r"(?:some|no) rights reserved", 70), ("tous droits", r"tous droits r[ée]serv[ée]s", 70), ("alle rechte", r"alle rechte vorbehalten", 70), ("todos los derechos", r"todos los derechos reservados", 70)],
        "public-domain": [("public domain", r"(?:in|into|to) the public domain", 65), ("public domain", r"public domain(?: dedication)?", 75), ("gemeinfrei", r"gemeinfrei", 75), ("domaine public", r"domaine public", 75), ("dominio público", r"dominio público", 75)],
        "permission": [("permission", r"permission is hereby granted(?: free of charge)?", 60), ("permission", r"used (?:with|by) permission", 75), ("permission", r"(?:without|with) (?:prior |express )*(?:written )?permission", 75), ("permission", r"all permissions? granted", 80)],
        "redistribution": [("redistribut", r"redistribution and use in source and binary forms", 55), ("redistribut", r"redistributions of source code must retain", 60), ("redistribut", r"redistributions in binary form must reproduce", 60), ("redistribut", r"(?:may|can) be (?:freely )?redistributed", 75), ("redistribut", r"(?:no|not for) redistribution", 70)],
        "warranty": [("warrant", r"without warrant(?:y|ies) of any kind", 75), ("warrant", r"without any warranty", 75), ("as is", r"provided (?:by the \w+ )?as is", 75), ("warrant", r"express or implied warrant(?:y|ies)", 78), ("liab", r"in no event shall", 80)],
        "non-commercial": [("non commercial", r"(?:for )?non commercial (?:use|purposes)(?: only)?", 70), ("noncommercial", r"(?:for )?noncommercial (?:use|purposes)(?: only)?", 70), ("commercial", r"not for commercial use", 70), ("personal and non", r"personal and non ?commercial use", 68), ("educational", r"for educational (?:use|purposes) only", 72)],
        "proprietary": [("proprietary", r"proprietary and confidential", 65), ("confidential", r"confidential and proprietary", 65), ("proprietary", r"proprietary licen[cs]e", 70), ("trade secret", r"trade secrets?", 80), ("unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)", 70), ("unauthorised", r"unauthorised (?:copying|use|reproduction|distribution)", 70)],
        "license": [("licen", r"licensed under", 90), ("licen", r"released under", 90), ("licen", r"under the terms of", 90), ("licen", r"end user licen[cs]e agreement", 65), ("licen", r"dual licensed", 80), ("spdx", r"spdx license identifier", 60), ("licen", r"see (?:the )?licen[cs]e(?: file)?(?: for details)?", 85), ("licen", r"site licen[cs]e", 85)],
        "terms": [("terms", r"terms (?:of (?:use|service)|and conditions)", 80), ("reproduc", r"(?:may|must) not be reproduced", 70), ("reproduc", r"no part of this (?:publication|work|book) may be reproduced", 60), ("trademark", r"(?:registered )?trademarks? of", 85)],
    }
    return [(label, keyword, regex, priority) for label, rules in wording.items() for keyword, regex, priority in rules]


@lru_cache(maxsize=1)
def rules() -> list[dict]:
    """All rules, best priority first: label, keyword, regex over the canonical form, priority, base."""
    made = [{"label": label, "keyword": f" {phrase} ", "regex": phrase, "priority": 0, "base": True} for phrase, label in BASE.items()]
    made += [{"label": a, "keyword": k, "regex": r, "priority": p, "base": False} for a, k, r, p in [*_creative_commons(), *_gnu(), *_named(), *_notices()]]
    for rule in made:
        rule["keyword"] = f" {rule['keyword'].lstrip()}"
        rule["regex"] = f"(?<= )(?:{rule['regex']})(?= )"
    return sorted(made, key=lambda x: (x["priority"], x["label"], x["regex"]))


def canonical_words(text: Column) -> Column:
    """Words (runs of digits, letters and anything beyond ASCII) with a space before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


_HIT = "array<struct<label:string,priority:int,base:boolean,start:int,stop:int>>"


def _literal_rules() -> Column:
    made = [F.struct(F.lit(r["label"]).alias("label"), F.lit(r["keyword"]).alias("keyword"), F.lit(r["regex"]).alias("regex"), F.lit(r["priority"]).alias("priority"), F.lit(r["base"]).alias("base")) for r in rules()]
    return F.array(*made)


def _gate() -> str:
    """One regex over the canonical form that finds a word at which any keyword starts, in any case; grouped by first
    letter, so that most words cost one step."""
    by: dict[str, set[str]] = {}
    for rule in rules():
        by.setdefault(rule["keyword"][1], set()).add(rule["keyword"][2:])
    return "(?i) (?:" + "|".join(f"{a}(?:{'|'.join(sorted(rest))})" for a, rest in sorted(by.items())) + ")"


def _hits(words: Column) -> Column:
    """Every match of every rule whose keyword occurs, with its first and last word."""
    held = F.filter(_literal_rules(), lambda r: F.contains(words, r["keyword"]))

    def places(r: Column) -> Column:
        found = F.regexp_extract_all(words, r["regex"], F.lit(0))
        marked = F.split(F.trim(F.regexp_replace(words, r["regex"], F.lit("\u0001$0"))), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")), i)), lambda i: i.isNotNull())
        return F.zip_with(
            starts, found,
            lambda a, m: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["base"].alias("base"), a.alias("start"), (a + _spaces(m)).alias("stop")),
        )

    return F.flatten(F.transform(held, places))


def _suppressed(hits: Column) -> Column:
    def inside(h: Column, g: Column) -> Column:
        longer = (g["stop"] - g["start"]) > (h["stop"] - h["start"])
        better = (g["priority"] < h["priority"]) | ((g["priority"] == h["priority"]) & longer)
        return (g["start"] <= h["start"]) & (h["stop"] <= g["stop"]) & better & ~g["base"]

    return F.filter(hits, lambda h: h["base"] | ~F.exists(hits, lambda g: inside(h, g)))


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, and ``detections``: label, priority, base, first and last word of what the rules find and no
    better rule covers. Columns of these names are replaced."""
    made = df.withColumn("__words", canonical_words(text_of(text)))
    words = F.col("__words")
    none = F.array().cast(_HIT)
    made = made.withColumn("n_words", F.greatest(_spaces(words) - 1, F.lit(0)).cast("long"))
    made = made.withColumn("__lower", F.when(F.rlike(words, F.lit(_gate())), _lower(words)))
    made = made.withColumn("__hits", F.when(F.col("__lower").isNotNull(), _hits(F.col("__lower"))).otherwise(none))
    return made.withColumn("detections", F.when(F.size("__hits") > 0, _suppressed(F.col("__hits"))).otherwise(none)).drop("__words", "__lower", "__hits")


def license_digest(df: DataFrame) -> DataFrame:
    """Counts, places, labels and score from ``detections``."""
    hits = F.col("detections")
    base = F.filter(hits, lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"].cast("long"))
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda h: h["label"]))), ",")
    covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["stop"])))))
    return df.select(
        "*",
        F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(hits).alias("labels"),
        F.when(F.size(hits) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(0.5) + 0.5 * covered / F.greatest(F.col("n_words"), F.lit(1)))).alias("score"),
    )
