"""License scan by ordered signature rules.

A text is lower-cased (A-Z only) and cut into words of ASCII letters, digits and any non-ASCII
characters; its words, joined by single spaces, are what the rules read.  An Aho-Corasick
automaton finds the rules' keywords in one pass, and only rules whose keyword is there run their
regular expression.  Detections are then taken in order of priority, length and place; one that
lies inside an interval taken before is suppressed, so "gnu general public license version 2 or
later" isn't also reported as the bare license name.  The base phrases are never suppressed.

There are some 300 rules of sentences and phrases from the licenses' own texts and notices
(``license_texts``), written by hand, and rules for names with versions, where every name of the
families below is crossed with its versions and ways of writing them.

Defined cases: null and empty texts have no words and no labels; places of a phrase may overlap;
texts of any length are read whole, each rule in linear time; d detections are sorted and told apart
from those that hold them in d log d steps; rows are independent, so copies and ties repeat their
results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_SCORE = 0.9

# Names, abbreviations and versions of licenses.
GNU = {
    "gpl": ("general public license", "gpl", ("1", "2", "3")),
    "lgpl": ("(?:lesser|library) general public license", "lgpl", ("2", "2.1", "3")),
    "agpl": ("affero general public license", "agpl", ("1", "3")),
    "gfdl": ("free documentation license", "gfdl", ("1.1", "1.2", "1.3")),
}
#: What the licenses' standard headers have between name and version.
AS_PUBLISHED = "(?:as published by the free software foundation (?:either )?)?"
COMMONS = {
    "cc-by": ("by", "attribution"),
    "cc-by-sa": ("by sa", "attribution share ?alike"),
    "cc-by-nd": ("by nd", "attribution no ?deriv(?:ative)?s?"),
    "cc-by-nc": ("by nc", "attribution non ?commercial"),
    "cc-by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
VERSIONED = {
    "apache": (("apache (?:software )?license", "apache"), "apache", ("1.0", "1.1", "2.0")),
    "mpl": (("mozilla public license", "mpl"), "m(?:ozilla public license|pl)", ("1.0", "1.1", "2.0")),
    "epl": (("eclipse public license", "epl"), "e(?:clipse public license|pl)", ("1.0", "2.0")),
    "eupl": (("european union public licence", "eupl"), "eupl", ("1.0", "1.1", "1.2")),
    "cddl": (("common development and distribution license", "cddl"), "cddl", ("1.0", "1.1")),
    "cpl": (("common public license", "cpl"), "cpl", ("1.0",)),
    "osl": (("open software license", "osl"), "osl", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    "afl": (("academic free license", "afl"), "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "artistic": (("artistic license",), "artistic", ("1.0", "2.0")),
    "ofl": (("sil open font license", "open font license"), "ofl", ("1.0", "1.1")),
    "odbl": (("open database license", "odbl"), "odbl", ("1.0",)),
    "psf": (("python software foundation license", "psf license"), "psf", ("2",)),
    "ecl": (("educational community license",), "ecl", ("1.0", "2.0")),
    "lppl": (("latex project public license", "lppl"), "lppl", ("1.0", "1.2", "1.3")),
    "zpl": (("zope public license", "zpl"), "zpl", ("1.1", "2.0", "2.1")),
    "ms-pl": (("microsoft public license", "ms pl"), "ms pl", ()),
    "ms-rl": (("microsoft reciprocal license", "ms rl"), "ms rl", ()),
    "cecill": (("cecill free software license", "cecill"), "cecill", ("1.0", "1.1", "2.0", "2.1")),
    "unlicense": (("the unlicense",), "unlicense", ()),
    "wtfpl": (("do what the fuck you want to public license", "wtfpl"), "wtfpl", ("1", "2")),
    "boost": (("boost software license", "bsl"), "boost", ("1.0",)),
    "isc": (("isc license",), "isc", ()),
    "zlib": (("zlib license", "zlib libpng license"), "zlib", ()),
    "ncsa": (("university of illinois ncsa open source license",), "ncsa", ()),
    "postgresql": (("postgresql license",), "postgresql", ()),
    "openssl": (("openssl license",), "openssl", ()),
    "cc0": (("cc0", "creative commons zero"), "cc0", ("1.0",)),
    "beerware": (("beerware license", "beer ware license"), "beerware", ()),
    "json": (("json license",), "json", ()),
    "php": (("php license",), "php", ("3.0", "3.01")),
    "ruby": (("ruby license",), "ruby", ()),
    "vim": (("vim license",), "vim", ()),
    "w3c": (("w3c software notice and license", "w3c license"), "w3c", ()),
    "x11": (("x11 license",), "x11", ()),
    "upl": (("universal permissive license",), "upl", ("1.0",)),
    "mulan-psl": (("mulan permissive software license", "mulan psl"), "mulan", ("1", "2")),
}
BSD = {"0bsd": ("zero clause", "0 clause"), "bsd-2-clause": ("2 clause", "two clause", "simplified"), "bsd-3-clause": ("3 clause", "three clause", "new", "modified", "revised"), "bsd-4-clause": ("4 clause", "four clause", "original")}
#: The words that announce a license by its identifier.
SPDX = "spdx license identifier"


@dataclass(frozen=True)
class Rule:
    """``keyword`` is a literal, from the start of a word, that every match of ``pattern`` holds.  If the
    pattern has a group ``id``, that says the label, with spaces for hyphens and dots."""

    label: str
    pattern: str
    keyword: str
    priority: int
    score: float


def _version(v: str) -> str:
    """A version's writings: "2.0" stands as the words "2 0", and often as "2" alone."""
    major, _, minor = v.partition(".")
    tail = "" if not minor else " 0" if minor == "0" else f" {minor}"
    return f"(?:v(?:ersion)? ?)?{major}(?:{tail})?(?! \\d)" if minor == "0" else f"(?:v(?:ersion)? ?)?{major}{tail}"


def literal(pattern: str) -> str:
    """The longest literal, from the start of a word, that every match of a pattern holds."""
    runs, run, depth, k = [], "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c in "([":
            depth += 1
        if depth or c in ".{?*+}":
            if run and c in "?*{":
                run = run[:-1]
            runs.append(run)
            run = ""
            if c == "{":
                k = pattern.index("}", k)
        else:
            run += c
        if c in ")]":
            depth -= 1
            run = "\0"  # what follows a group may go on with its word
        k += 1
    runs.append(run)
    # Behind a group or a wildcard only whole words count.
    first, *others = runs
    whole = [first] + [r[r.index(" ") + 1 :] for r in others if " " in r]
    return max((r.strip() for r in whole), key=len)


def build_rules() -> list[Rule]:
    """All rules, in order of priority."""
    rules: list[Rule] = []
    for label, (name, short, versions) in GNU.items():
        keyword = "general public license" if "general" in name else name
        rules.append(Rule(label, f"(?:gnu )?{name}", keyword, 20, 0.8))
        for v in versions:
            for suffix, tail, extra in (("-or-later", " (?:of the license )?(?:or (?:at your option )?any later version|or later)", 20), ("-only", " only", 20), ("", "", 10)):
                number = _version(v + ".0" if "." not in v else v)
                rules.append(Rule(f"{label}-{v}{suffix}", f"(?:gnu )?{name} {AS_PUBLISHED}{number}{tail}", keyword, 30 + extra, 0.95))
                rules.append(Rule(f"{label}-{v}{suffix}", f"(?:gnu )?{short} ?{number}{tail}", short, 25 + extra, 0.85))
    for label, (short, long) in COMMONS.items():
        rules.append(Rule(label, f"cc {short}", "cc by", 15 + len(short), 0.8))
        rules.append(Rule(label, f"creative commons {long}", "creative commons", 15 + len(short), 0.85))
        for v in COMMONS_VERSIONS:
            number = v.replace(".", " ")
            rules.append(Rule(f"{label}-{v}", f"cc {short} {number}", "cc by", 40 + len(short), 0.95))
            rules.append(Rule(f"{label}-{v}", f"creative commons {long} (?:international |unported |generic )?(?:license )?(?:version )?{number}", "creative commons", 40 + len(short), 0.95))
            rules.append(Rule(f"{label}-{v}", f"creativecommons org licenses {short} {number}", "creativecommons", 45 + len(short), 0.95))
    for label, (names, _, versions) in VERSIONED.items():
        for name in names:
            keyword = name if "(" not in name else "apache"
            named = name if " " in name or name in ("cc0", "wtfpl", "odbl", "lppl", "cecill", "eupl", "cddl") else None
            if named:
                rules.append(Rule(label, name, keyword, 15, 0.7))
            for v in versions:
                number = _version(v)
                rules.append(Rule(f"{label}-{v}", f"{name} {number}" if named else f"{name} (?=v|\\d){number}", keyword, 35, 0.9))
    for label, names in BSD.items():
        for name in names:
            rules.append(Rule(label, f"(?:{name} bsd|bsd {name})(?: licen[sc]e)?", "bsd", 30, 0.9))
    rules.append(Rule("bsd", "bsd licen[sc]e", "bsd", 15, 0.7))
    rules += [Rule(label, text, literal(text), 20 + min(60, len(text) // 8), 0.75 if len(text) < 30 else 0.95) for label, text in TEXTS]
    ids = sorted({re.sub(r"[-.]", " ", r.label) for r in rules}, key=lambda x: (-len(x), x))
    rules.append(Rule("", f"{SPDX} (?P<id>{'|'.join(map(re.escape, ids))})(?! \\d)", SPDX, 90, 1.0))
    return sorted(rules, key=lambda r: -r.priority)


_DROP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def normalized(text: str | None) -> tuple[str, int]:
    """The words of a text, each with a space before and after, and their number."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().translate(_DROP).split(b" ")
    ws = [w for w in ws if w]
    return (b" " + b" ".join(ws) + b" ").decode("utf-8", "surrogatepass") if ws else " ", len(ws)


@dataclass(frozen=True)
class Detection:
    label: str
    first_word: int
    n_words: int
    score: float
    base: bool


class _Ends:
    """The largest end of the intervals taken so far that begin at a place or before (a Fenwick tree)."""

    def __init__(self, n: int):
        self.top = [-1] * (n + 1)

    def add(self, place: int, end: int) -> None:
        place += 1
        while place < len(self.top):
            if self.top[place] < end:
                self.top[place] = end
            place += place & -place

    def upto(self, place: int) -> int:
        place, end = place + 1, -1
        while place:
            if self.top[place] > end:
                end = self.top[place]
            place -= place & -place
        return end


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        import ahocorasick

        self.rules = build_rules() if rules is None else sorted(rules, key=lambda r: -r.priority)
        self.patterns = [re.compile(rf"(?<= )(?:{r.pattern})(?= )") for r in self.rules]
        self.labels = {re.sub(r"[-.]", " ", r.label): r.label for r in self.rules}
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            by_word.setdefault(f" {r.keyword}", []).append(i)
        for phrase, _ in BASE:
            by_word.setdefault(f" {phrase} ", [])
        self.automaton = ahocorasick.Automaton()
        for word, ids in by_word.items():
            self.automaton.add_word(word, (word, ids))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, list[Detection]]:
        line, n = normalized(text)
        hits = {word: ids for _, (word, ids) in self.automaton.iter(line)} if n else {}
        if not hits:
            return n, []
        # label, first character, end, score, base
        places: list[tuple[str, int, int, float, bool]] = []
        for phrase, label in BASE:
            at = line.find(f" {phrase} ")
            while at >= 0:
                places.append((label, at + 1, at + 1 + len(phrase), BASE_SCORE, True))
                at = line.find(f" {phrase} ", at + 1)
        raw = []
        for i in sorted({i for ids in hits.values() for i in ids}):
            r = self.rules[i]
            raw += [(-r.priority, m.start() - m.end(), m.start(), i, m) for m in self.patterns[i].finditer(line)]
        raw.sort(key=lambda x: x[:4])
        begins = {lo: k for k, lo in enumerate(sorted({x[2] for x in raw}))}
        taken = _Ends(len(begins))
        for _, _, lo, i, m in raw:
            if taken.upto(begins[lo]) < m.end():
                taken.add(begins[lo], m.end())
                r = self.rules[i]
                places.append((r.label or self.labels[m["id"]], lo, m.end(), r.score, False))
        if not places:
            return n, []
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        first = np.searchsorted(spaces, [p[1] - 1 for p in places])
        last = np.searchsorted(spaces, [p[2] for p in places])
        found = [Detection(label, int(a), int(b - a), score, base) for (label, _, _, score, base), a, b in zip(places, first, last)]
        return n, sorted(found, key=lambda d: (d.first_word, d.n_words, d.label, d.base))


SCHEMA = "n_words long, detections array<struct<label:string,first_word:long,n_words:long,score:double,base:boolean>>"


def _scan_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    scan = Scanner()
    for texts in batches:
        rows = [scan(None if t is None else t) for t in texts]
        yield pd.DataFrame({"n_words": [n for n, _ in rows], "detections": [[d.__dict__ for d in ds] for _, ds in rows]})


def scan(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with a struct column: the number of words, and the detections with their places."""
    return docs.withColumn(into, F.pandas_udf(_scan_batches, SCHEMA)(F.col(text)))


def op9(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), into="x").select("doc_id", "x.n_words", F.col("x.detections").alias("all"))
    base = F.filter("all", lambda d: d["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("all")).alias("labels"),
        F.coalesce(F.array_max(F.transform("all", lambda d: d["score"])), F.lit(0.0)).alias("score"),
    )
