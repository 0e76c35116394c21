"""Language identification: Viterbi against brute force, mixed texts, held-out accuracy."""

import math
import os
import re
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pytest

from lacuna.llm.langid import SWITCH, UNKNOWN, held_out, identify, op5, script_of, train, viterbi

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"
A, B, C = "thing that other then there", "schein einer keit verein die", "привет мир это текст слова"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, {"a": A, "b": B, "c": C}[l], l) for i, l in enumerate("abc" * 20)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi(seed):
    r = np.random.default_rng(seed)
    scores = r.normal(size=(12, 3)).astype(np.float32)
    sizes = np.array([3, 0, 5, 1])
    ids = r.integers(0, 12, sizes.sum())
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    got = viterbi(scores, ids, starts, sizes, 0.7)
    value = lambda own, ls: sum(float(scores[i, l]) for i, l in zip(own, ls)) - 0.7 * sum(x != y for x, y in zip(ls, ls[1:]))
    for lo, n in zip(starts, sizes):
        own = ids[lo : lo + n]
        assert value(own, got[lo : lo + n].tolist()) == pytest.approx(max(value(own, ls) for ls in product(range(3), repeat=n)))


def test_spans_and_scripts(docs):
    m = train(docs)
    assert [sorted(s) for s in m.scripts] == [["latin"], ["latin"], ["cyrillic"]]
    (lang, score, spans), *rest = identify(m, [f"{A} {A} {B} {B} {B}", C, "日本語", "12 !", None, ""])
    assert lang == "b" and 0.5 < score < 0.8 and [(s[0], s[1], s[2]) for s in spans] == [("a", 0, 10), ("b", 10, 15)]
    assert rest[0][:2] == ("c", 1.0) and rest[1][0] in "abc" and rest[1][1] == 0.0
    assert [r[0] for r in rest[2:]] == [UNKNOWN] * 3
    assert script_of("ñ") == "latin" and script_of("한") == "hangul" and script_of("ʘ") == "other"


def test_query_uses_text_alone(spark, docs):
    got = {r.doc_id: r for r in op5(docs.unionByName(spark.createDataFrame([(99, A, None), (99, None, "a"), (None, B, "b")], SCHEMA))).collect()}
    assert got[None].lang_pred == "b" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert op5(docs.limit(0)).count() == 0
    none = op5(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r.lang_pred for r in none} == {UNKNOWN}


def learned(rows, least=2):
    """The model's scores by plain counting: log shares of n-grams per language, less their mean."""
    langs, counts = sorted({l for *_, l in rows}), {}
    for _, text, l in rows:
        for w in re.findall(r"[^\W\d_]+", text):
            marked = f"^{w.lower()}$"
            for g in [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)] + [marked]:
                counts.setdefault(g, Counter())[l] += 1
    counts = {g: c for g, c in counts.items() if sum(c.values()) >= least}
    total = {l: sum(c[l] for c in counts.values()) for l in langs}
    weights = {}
    for g, c in counts.items():
        logs = [math.log((c[l] + 0.5) / (total[l] + 0.5 * (len(counts) + 1))) for l in langs]
        weights[g] = [x - sum(logs) / len(logs) for x in logs]
    return langs, weights


def brute_label(langs, weights, text):
    """The best of all labellings of a text's words, by trying each."""
    ws = re.findall(r"[^\W\d_]+", text)
    scores = []
    for w in ws:
        marked = f"^{w.lower()}$"
        own = [weights[g] for g in [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)] + [marked] if g in weights]
        scores.append([sum(x[k] for x in own) for k in range(len(langs))])
    best = max(product(range(len(langs)), repeat=len(ws)), key=lambda ls: sum(s[l] for s, l in zip(scores, ls)) - SWITCH * sum(a != b for a, b in zip(ls, ls[1:])))
    letters = Counter()
    for w, s, l in zip(ws, scores, best):
        if any(s):
            letters[langs[l]] += len(w)
    top = max(letters, key=letters.get)
    return top, letters[top] / sum(letters.values())


def test_predictions_against_brute_force(spark):
    """Whole predictions: training, word scores, spans and shares, by plain counting and trying."""
    rows = [(i, {"a": A, "b": B}[l] + " " + {"a": "house river", "b": "haus fluss"}[l], l) for i, l in enumerate("ab" * 20)]
    m = train(spark.createDataFrame(rows, SCHEMA))
    taught = [r for r in rows if crc32(str(r[0]).encode()) % 4 != 2]
    langs, weights = learned(taught)
    assert set(weights) == set(m.index)
    r = np.random.default_rng(4)
    words = (A + " " + B + " house river haus fluss unbekannt xyz").split()
    for _ in range(40):
        text = " ".join(r.choice(words, r.integers(1, 9)))
        want, got = brute_label(langs, weights, text), identify(m, [text])[0]
        assert got[0] == want[0] or got[1] == pytest.approx(0.5), text
        assert got[1] == pytest.approx(want[1], abs=1e-6), text


def test_one_language(spark, docs):
    m = train(docs.filter("lang = 'a'"))
    assert [r[:2] for r in identify(m, [A, "unseen", C, "12"])] == [("a", 1.0), ("a", 1.0), ("a", 0.0), (UNKNOWN, 0.0)]


def test_odd_rows(spark, docs):
    """Ties, repeated rows, very long texts and clashing columns."""
    rows = [(500, f"{A} {B}", None)] * 3 + [(501, f"{A} " * 40_000, None), (502, "z" * 300_000, None), (503, f"{A} {C} " * 9000, None)]
    more = docs.unionByName(spark.createDataFrame(rows, SCHEMA)).selectExpr("*", "1 AS x", "2 AS score", "3 AS held_out", "4 AS lang_pred", "5 AS gram", "6 AS n", "7 AS by")
    got = [(r.doc_id, r.lang_pred, r.score) for r in op5(more).collect() if r.doc_id >= 500]
    same = {x[1:] for x in got if x[0] == 500}
    assert len(got) == 6 and len(same) == 1
    by = {k: (l, s) for k, l, s in got}
    assert by[501] == ("a", 1.0) and by[503][0] in "ac" and 0.4 < by[503][1] < 0.7 and by[502][0] in "ab"


def test_held_out_rows_teach_nothing(spark, docs):
    out = [i for i in range(400) if crc32(str(i).encode()) % 4 == 2]
    more = spark.createDataFrame([(i, "qqq www zzz", "zz") for i in out], SCHEMA)
    assert {r[0] for r in more.select(held_out(more.doc_id)).collect()} == {True}
    m = train(docs.unionByName(more))
    assert m.langs == ["a", "b", "c"] and "zz$" not in m.index


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_held_out_accuracy(spark):
    from lacuna.llm.common import table

    docs = table(spark, SF, "documents")
    pairs = op5(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in pairs) >= 0.97 * len(pairs)
