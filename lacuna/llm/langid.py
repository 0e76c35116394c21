"""Language identification of whole texts, mixed ones included.

A word's script, read from code-point ranges, narrows its candidate languages to those whose
training text used that script.  Character n-grams score a word for each candidate; Viterbi over
the words of a text, with a penalty for every switch, labels spans of one language each.  The
language with the most letters in its spans is the text's language, and its share of all scored
letters is the score.

Learning takes at most ``SAMPLE`` documents per language (chosen by a hash of doc_id, the same in
every run; whole texts) and keeps every n-gram seen there ``LEAST_SEEN`` times or more; only this
model, which the sample bounds, goes to the driver and out to the workers.

Defined cases: a null text, an empty one, and one without letters is ``und`` with score 0; letters
of scripts that no language was learned with are left out, and a text of nothing else gets the
most frequent learned language with score 0; without any labelled row everything is ``und``;
with one learned language its scripts decide; ties go to the language first in order; texts of any
length are labelled whole; repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, release, settle

UNKNOWN = "und"
SAMPLE = 1000
#: Times that an n-gram must be seen in the sample.
LEAST_SEEN = 2
NGRAM = 3
SWITCH = 12.0
#: A script belongs to a language if it has at least this share of the language's letters.
SCRIPT_SHARE = 0.01
#: Distinct words whose scores a worker remembers.
WORDS_KEPT = 150_000

# Code-point ranges of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x137F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
_WORDS = re.compile(r"[^\W\d_]+")
_RANGES = sorted((lo, hi, name) for name, rs in SCRIPTS.items() for lo, hi in rs)
_LOWS = np.array([r[0] for r in _RANGES])


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    at = int(np.searchsorted(_LOWS, ord(word[0]), "right")) - 1
    return _RANGES[at][2] if at >= 0 and ord(word[0]) <= _RANGES[at][1] else "other"


def grams(word: str) -> list[str]:
    """A word's n-grams, with its ends marked, and the word itself."""
    w = f"^{word.lower()}$"
    return [w[i : i + n] for n in (2, NGRAM) for i in range(len(w) - n + 1)] + [w]


def held_out(doc_id: Column) -> Column:
    """Documents that nothing may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Languages in order; log-probabilities of n-grams per language; the scripts of each."""

    langs: list[str]
    index: dict[str, int]
    weights: np.ndarray
    scripts: list[set[str]]
    common: int
    known: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": []}


def train(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST_SEEN) -> Model:
    """Learn from the labelled documents (doc_id, text, lang) that are not held out."""
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], {}, np.zeros((1, 0), np.float32), [], 0)
    langs = sorted(sizes)
    # Every language is thinned to its share by a hash, so the sample is about SAMPLE documents.
    share = F.create_map(*[F.lit(x) for l in langs for x in (l, min(1.0, sample / sizes[l]))])
    chosen = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                seen.setdefault(lang, Counter()).update(_WORDS.findall(text))
        counts: dict[str, Counter] = {}
        for lang, ws in seen.items():
            c = counts.setdefault(lang, Counter())
            for word, n in ws.items():
                for g in grams(word):
                    c[g] += n
                c[f"\0{script_of(word)}"] += n * len(word)
        rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "gram", "n"]).astype({"n": "int64"})

    sums = chosen.select("text", "lang").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A gram has a row per language at most.
    per = settle(sums.groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")), "grams")
    script = per.filter(F.col("gram").startswith("\0")).collect()
    top = sorted(per.filter(~F.col("gram").startswith("\0") & (F.col("all") >= least)).collect(), key=lambda r: r["gram"])
    release(per)
    of = {l: i for i, l in enumerate(langs)}
    counts = np.zeros((len(top) + 1, len(langs)))
    for k, r in enumerate(top):
        for b in r["by"]:
            counts[k, of[b["lang"]]] = b["n"]
    letters = np.zeros(len(langs))
    for r in script:
        for b in r["by"]:
            letters[of[b["lang"]]] += b["n"]
    scripts = [set() for _ in langs]
    for r in script:
        for b in r["by"]:
            if b["n"] >= SCRIPT_SHARE * letters[of[b["lang"]]]:
                scripts[of[b["lang"]]].add(r["gram"][1:])
    total = counts.sum(axis=0)
    weights = np.log((counts + 0.5) / (total + 0.5 * len(counts)))
    weights -= weights.mean(axis=1, keepdims=True)
    weights[-1] = 0  # n-grams outside the model say nothing
    return Model(langs, {r["gram"]: k for k, r in enumerate(top)}, weights.astype(np.float32), scripts, int(np.argmax([sizes[l] for l in langs])))


def viterbi(scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every place.  Text d has places ``starts[d]`` to ``starts[d] + sizes[d] - 1``
    and place i the scores ``scores[ids[i]]``; all texts advance together, one word a step."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    n_labels = scores.shape[1]
    labels = np.zeros(len(ids), np.int16)
    jumps, origin = np.zeros((len(ids), n_labels), bool), np.zeros(len(ids), np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    best = np.zeros((len(sizes), n_labels), np.float64)
    for t in range(longest):
        a = active[t]
        at, d = starts[:a] + t, best[:a]
        if t:
            top = d.argmax(axis=1)
            reach = d[np.arange(a), top] - penalty
            jump = reach[:, None] > d
            jumps[at], origin[at] = jump, top
            np.maximum(d, reach[:, None], out=d)
        d += scores[ids[at]]
    current = best.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at, c = starts[:a] + t, current[:a]
        labels[at] = c
        current[:a] = np.where(jumps[at, c], origin[at], c)
    return labels


def _learn_words(model: Model, new: list[str], at_once: int = 20_000) -> None:
    """Score new words and remember them."""
    none, index = len(model.weights) - 1, model.index
    allowed: dict[str, np.ndarray] = {}
    for lo in range(0, len(new), at_once):
        part = new[lo : lo + at_once]
        flat, ends = [], []
        for w in part:
            flat += [index.get(g, none) for g in grams(w)]
            ends.append(len(flat))
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        out = np.add.reduceat(model.weights[np.array(flat, np.int32)], starts, axis=0)
        if len(model.langs) == 1:  # nothing to weigh against: the script alone decides
            out[:] = 1.0
        for k, w in enumerate(part):
            s = script_of(w)
            if s not in allowed:
                allowed[s] = np.array([s in x for x in model.scripts])
            if not allowed[s].all():
                # Out of the running: far behind the best, or neutral where no language has the script.
                out[k] = np.where(allowed[s], out[k], -50.0 * len(w)) if allowed[s].any() else 0.0
        model.rows.append(out)


def identify(model: Model, texts: list[str | None], penalty: float = SWITCH) -> list[tuple[str, float, list[tuple[str, int, int, int]]]]:
    """(language, score, spans) per text; a span is (language, first word, words, letters)."""
    if not model.langs:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    if len(model.known) > WORDS_KEPT:
        model.known, model.rows = {}, []
    known, parts, new = model.known, [], []
    for text in texts:
        ws = _WORDS.findall(text) if text else []
        try:
            parts.append(np.array([known[w] for w in ws], np.int32))
        except KeyError:
            for w in ws:
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
            parts.append(np.array([known[w] for w in ws], np.int32))
    if new:
        _learn_words(model, new)
        model.rows = [np.concatenate(model.rows)]
    if not known:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    scores = model.rows[0]
    counted = np.fromiter((len(w) for w in known), np.int64, len(known)) * (scores != 0).any(axis=1)
    sizes = np.array([len(p) for p in parts], np.int64)
    ids = np.concatenate(parts)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    labels = viterbi(scores, ids, starts, sizes, penalty)
    weight = counted[ids]
    out = []
    for text, lo, n in zip(texts, starts.tolist(), sizes.tolist()):
        own, w = labels[lo : lo + n], weight[lo : lo + n]
        if not n or not any(c.isalpha() for c in text):
            out.append((UNKNOWN, 0.0, []))
            continue
        cuts = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, n]
        sums = np.add.reduceat(w, cuts[:-1])
        spans = [(model.langs[own[a]], int(a), int(b - a), int(s)) for a, b, s in zip(cuts[:-1], cuts[1:], sums)]
        by = np.bincount(own, weights=w, minlength=len(model.langs))
        top, total = int(by.argmax()), float(by.sum())
        out.append((model.langs[top], float(by[top]) / total, spans) if total else (model.langs[model.common], 0.0, spans))
    return out


SCHEMA = "lang string, score double, spans array<struct<lang:string,first_word:long,n_words:long,letters:long>>"
#: Characters that are labelled together.
CHARS_AT_ONCE = 3_000_000


def label(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column: the text's language, score and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            rows, held, n = [], [], 0
            for t in [*texts, None]:
                held.append(t)
                n += len(t or "")
                if n > CHARS_AT_ONCE:
                    rows += identify(m, held)
                    held, n = [], 0
            rows = (rows + (identify(m, held) if held else []))[: len(texts)]
            yield pd.DataFrame({"lang": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [[dict(zip(("lang", "first_word", "n_words", "letters"), s)) for s in r[2]] for r in rows]})

        m.known, m.rows = {}, []  # the worker lives on and others need the room
        give_back()

    return docs.withColumn(into, F.pandas_udf(run, SCHEMA)(F.col(text)))


def op5(docs: DataFrame) -> DataFrame:
    out = label(docs.select("doc_id", "text"), train(docs), into="x")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))
