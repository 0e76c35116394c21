"""Quality rules against plain Python, on odd texts."""

import re
from collections import Counter

import pytest

from lacuna.llm.quality import RULES, assess, op3

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The quick brown fox and the lazy dog went to the river in that year, for it was warm. "
TEXTS = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a", "x y z", "l\nl\n\nl\n m\n", "#*$ %&| <>", GOOD * 5, " ".join(f"w{i}" for i in range(400)), "the of " * 3000, "é\x0b!\x0c…\n- x", "\x1fa \x00b", "ein der die und " * 20]


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    places = {p for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    ls = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(places)


def test_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "0 AS n_words", "1 AS q")
    for r in op3(docs).collect():
        counts = brute(TEXTS[r.doc_id])
        assert tuple(r)[1:6] == counts, TEXTS[r.doc_id]
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(
    "text, rule",
    [
        (" | ".join(f"word{i} the more{i}" for i in range(60)), "symbol_ratio"),
        (" ".join(f"of!! and{i}!!" for i in range(60)), "shout_ratio"),
        (" ".join(f"THE AND WORD{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)), "upper_ratio"),
        (" ".join(f"{i} {i}{i}" for i in range(100, 160)), "letter_words"),
        (" ".join(f"zz{i}q" for i in range(100)), "stop_words"),
    ],
)
def test_rules(spark, text, rule):
    q = assess(spark.createDataFrame([(text,)], "text string"), into="q").first().q
    assert rule in q.failed_rules and not q.kept and not q.base_failed


def test_good_text_stays_and_plan_is_native(spark):
    docs = spark.createDataFrame([(1, GOOD + " ".join(f"with the number{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)))], "doc_id long, text string")
    assert op3(docs).first().kept
    plan = op3(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert len({r.name for r in RULES}) == len(RULES)
    assert op3(docs.limit(0)).count() == 0


def test_repeated_rows_and_long_texts(spark):
    """Equal rows give equal rows; a null doc_id and a very long text are rows like others."""
    long = " ".join(f"the word{i % 9000}" for i in range(60_000))
    rows = [(1, GOOD * 5)] * 4 + [(None, GOOD), (2, long), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in op3(docs).collect())))
    assert len(got) == 7 and len(set(got)) == 4
    for r in op3(docs.filter("doc_id = 2 AND text IS NOT NULL")).collect():
        assert tuple(r)[1:6] == brute(long)
