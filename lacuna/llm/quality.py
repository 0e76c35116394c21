"""Quality rules as one Spark projection, without user functions.

A table of thresholds (``RULES``) over length, symbol, repetition, stop-word and line ratios is
compiled into column expressions.  Everything of a text is worked out within its row: there is no
shuffle, and rows are independent, so copies, ties and repeated rows need no care.

Defined cases: null and empty texts have no words and fail the base rule; an empty table gives an
empty table; very long texts are sorted within their row, in n log n steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "#*$%&|<>"
# Frequent function words of the languages at hand; text made of sentences has some.
STOP_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er aus bei",
    "en": "the of and to a in is that it was for on as with be by at he this are from or an",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
    "fr": "de la le et les des en un du une que est pour qui dans il ne sur pas par au ce on",
}
ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})


@dataclass(frozen=True)
class Rule:
    """A document fails if ``100 * part`` lies outside ``low`` to ``high`` times ``whole``; both bounds
    may be open.  ``at_least`` is the number of words below which the rule says nothing."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    at_least: int = 0


#: The threshold table.  Ratios are in hundredths, compared in whole numbers.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbol_ratio", "n_symbols", "n_words", high=10),
    Rule("shout_ratio", "n_marks", "n_words", high=40),
    Rule("upper_ratio", "n_upper", "word_chars", high=40),
    Rule("letter_words", "n_letter_words", "n_words", low=70),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
)
MIN_WORDS = 50
MAX_REPEATED = 50


def _count_chars(text: Column, chars: str) -> Column:
    """How many characters of a regular expression's class a text has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more: windows are sorted with their
    places, neighbours that are alike mark both, and the marked places are measured in order.
    Most texts have none, which the windows' hashes tell at less cost: where no two hashes are
    equal, no two windows are."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 3, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("w"), i.alias("i"))))

    def marked(s: Column) -> Column:
        # Each window of a run of equals; (before, this) and (this, after) are compared by index.
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["w"].eqNullSafe(x["w"])) | (F.get(s, i + 1)["w"].eqNullSafe(x["w"])))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    none = (F.size(ws) < 4) | let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(none, F.lit(0)).otherwise(let(windows, lambda s: let(marked(s), covered)))


def measures(text: Column) -> Column:
    """A struct of all counts (long) of a text."""
    plain = F.coalesce(text, F.lit(""))

    def of(ws: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(ws),
            "word_chars": F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w)),
            "n_symbols": _count_chars(plain, SYMBOLS),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated_words(ws),
            "n_marks": _count_chars(plain, "!?"),
            "n_upper": _count_chars(plain, r"\p{Lu}"),
            "n_letter_words": F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))),
            "n_stop_words": F.size(F.filter(ws, lambda w: F.lower(w).isin(ALL_STOP_WORDS))),
            "n_lines": F.size(lines),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])

    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.struct(words(text).alias("w"), lines.alias("l")), lambda x: of(x["w"], x["l"]))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def failed(rule: Rule, m: Column) -> Column:
    part, whole = 100 * m[rule.part], m[rule.whole]
    tests = []
    if rule.low is not None:
        tests.append(part < rule.low * whole)
    if rule.high is not None:
        tests.append(part > rule.high * whole)
    out = reduce(lambda a, b: a | b, tests)
    return out & (m["n_words"] >= rule.at_least) if rule.at_least else out


def kept(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return ~reduce(lambda a, b: a | b, [failed(r, m) for r in rules], base_failed(m))


def assess(docs: DataFrame, text: str = "text", into: str = "quality_", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with one more column: a struct of the counts, ``base_failed``, ``kept`` and the
    names of the rules that failed."""
    m = measures(F.col(text))
    verdict = lambda x: F.struct(
        x.alias("counts"),
        base_failed(x).alias("base_failed"),
        kept(x, rules).alias("kept"),
        F.filter(F.array(*[F.when(failed(r, x), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull()).alias("failed_rules"),
    )
    return docs.withColumn(into, let(m, verdict))


def op3(docs: DataFrame) -> DataFrame:
    q = assess(docs.select("doc_id", "text"), into="q").select("doc_id", "q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return q.select("doc_id", *[F.col(f"q.counts.{n}").alias(n) for n in names], F.col("q.base_failed").alias("base_failed"), F.col("q.kept").alias("kept"))
