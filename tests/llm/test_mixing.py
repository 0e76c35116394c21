"""The mix: targets, the schedule, shares, repeats."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lacuna.llm import mixing
from lacuna.llm.common import settle
from lacuna.llm.mixing import mix, op4, place, reversed_bits, schedule, sizes, slot_bits, whole_documents


def targets(sizes):
    """Sharing by weight, with the excess over three times the size shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS size", "1 AS target", "2 AS rank", "3 AS tie", "4 AS k", "5 AS slot")


def placed(spark, rows):
    return place(settle(sizes(docs(spark, rows)), "mix-sizes"))


CASES = {
    "even": [(i, "w " * (20 + i % 30), f"s{i % 4}") for i in range(400)],
    "small source": [(i, "w " * 50, "a" if i == 0 else "b") for i in range(100)],
    "null source and empty texts": [(i, None if i % 7 == 0 else "w " * (i % 9 * 10), None if i % 3 == 0 else "b") for i in range(200)],
    "one hot source": [(i, "w " * 40, "hot" if i % 3 else f"s{i % 10}") for i in range(600)],
    "repeated rows": [(1, "a b c " * 30, "x")] * 40 + [(2, "d " * 900, "y")],
    "null ids": [(None, "a b c " * 30, "x")] * 40 + [(None, "d " * i, "y") for i in range(60)],
    "astral source names": [(i, "w " * 99, ("\U0001f600", "￿", "z")[i % 3]) for i in range(90)],
    "very long text": [(0, "w " * 120_000, "x"), (1, "v " * 70_000, "y")] + [(i, "w " * 30, "xyz"[i % 3]) for i in range(2, 60)],
}


def shares(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    return size, targets(size)


@pytest.mark.parametrize("case", CASES)
def test_shares(spark, case):
    rows = CASES[case]
    got = op4(docs(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(k), len((t or "").split())) for k, t, _ in rows)
    size, want = shares(rows)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and (r.n_slots == 0) == (r.taken == 0) == (r.first_slot is None)
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
    # A slot is BLOCK words at most.
    for s in size:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK
    again = op4(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_nothing(spark):
    assert op4(docs(spark, [])).count() == 0
    assert [tuple(r) for r in op4(docs(spark, [(1, " ", None)])).collect()] == [(1, 0, None, 0, 0.0, 0, 0, None)]
    assert whole_documents(docs(spark, [])).count() == whole_documents(docs(spark, [(1, " ", None)])).count() == 0


def brute_mix(p):
    """taken per row id, slot by slot: the van der Corput point names the source, its next block is read."""
    sources = sorted(p.targets.collect(), key=lambda r: r.lo)
    streams = defaultdict(list)
    for d in sorted(p.documents.collect(), key=lambda d: d.at):
        streams[d.source] += [d.k] * d.size
    taken, read, first = defaultdict(int), defaultdict(int), {}
    for slot in range(1 << p.bits):
        u = int(format(slot, f"0{p.bits}b")[::-1], 2) if p.bits else 0
        source = next(r.source for r in sources if r.lo <= u < r.hi)
        rank = read[source]
        read[source] += 1
        for at in range(rank * p.length // mixing.FRACTION, (rank + 1) * p.length // mixing.FRACTION):
            if at < 3 * len(streams[source]):
                k = streams[source][at % len(streams[source])]
                taken[k] += 1
                first.setdefault(k, slot)
    return taken, first


@pytest.mark.parametrize("case", ["even", "small source", "null source and empty texts", "one hot source", "repeated rows"])
def test_the_schedule_decides(spark, case):
    p = placed(spark, CASES[case])
    taken, first = brute_mix(p)
    got = mixing.taken_words(p).collect()
    assert {r.k: r.taken for r in got if r.taken} == dict(taken)
    assert {r.k: r.first_slot for r in got if r.taken} == first


def test_a_missing_slot_is_not_taken(spark, monkeypatch):
    """Without half of the schedule's slots half of the words go."""
    p = placed(spark, CASES["even"])
    whole = sum(r.taken for r in mixing.taken_words(p).collect())
    was = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: was(*a).filter("slot % 2 = 0"))
    half = sum(r.taken for r in mixing.taken_words(p).collect())
    assert half == pytest.approx(whole / 2, rel=0.02)


def test_schedule_is_even(spark):
    p = placed(spark, CASES["even"])
    slots = [r.s for r in schedule(p.targets, p.bits).orderBy("slot").collect()]
    assert len(slots) == 1 << p.bits
    share = {r.s: r.target / p.total for r in p.targets.collect()}
    for n in (20, 60, len(slots)):
        for s, x in share.items():
            assert abs(slots[:n].count(s) - n * x) <= 4
    ranks = schedule(p.targets, p.bits).groupBy("s").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.count("*").alias("n"), F.countDistinct("rank").alias("d")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 and r.d == r.n for r in ranks)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 7, 8, 13, 31, 33, 40])
def test_points(spark, bits):
    last = (1 << bits) - 1
    ks = sorted({k & last for k in (0, 1, 2, 3, 5, 1000, 12345678901, last, last // 3)})
    got = [tuple(r) for r in spark.createDataFrame([(k,) for k in ks], "k long").select("k", reversed_bits(F.col("k"), bits)).collect()]
    assert sorted(got) == [(k, int(format(k, f"0{bits}b")[::-1], 2) if bits else 0) for k in ks]


def test_slot_length():
    for total in (1, 63, 64, 65, 100, 5000, 10**13):
        n = 1 << slot_bits(total)
        assert n * mixing.BLOCK >= total and (n == 1 or n * mixing.BLOCK / 2 <= total)


def test_mix_words_are_whole(spark):
    p = placed(spark, CASES["even"])
    rows = mix(p).collect()
    assert all(0 <= r.first < r.last <= r.size for r in rows)
    per_slot = defaultdict(int)
    for r in rows:
        per_slot[r.slot] += r.last - r.first
    assert {p.length // mixing.FRACTION, p.length // mixing.FRACTION + 1} >= {n for n in per_slot.values()}


@pytest.mark.parametrize("case", CASES)
def test_whole_documents(spark, case):
    rows = CASES[case]
    frame = docs(spark, rows)
    out = whole_documents(frame)
    assert out.columns == frame.columns
    words, longest, times = defaultdict(int), defaultdict(int), defaultdict(int)
    _, want = shares(rows)
    for _, t, s in rows:
        longest[s] = max(longest[s], len((t or "").split()))
    for r in out.collect():
        words[r.source] += len(r.text.split())
        times[r.doc_id, r.text] += 1
    for s in want:
        # Half a document and a slot.
        assert abs(words[s] - want[s]) <= longest[s] / 2 + mixing.BLOCK
    given = defaultdict(int)
    for k, t, _ in rows:
        given[k, t] += 1
    assert all(n <= 3 * given[x] for x, n in times.items())


def test_whole_documents_are_mixed(spark):
    """Sources come in proportion all along the rows, and equal rows stay."""
    rows = [(i, "w " * 40, f"s{i % 3}") for i in range(900)]
    got = [r.source for r in whole_documents(docs(spark, rows)).collect()]
    for lo in range(0, len(got) - 200, 100):
        assert {s: got[lo : lo + 200].count(s) for s in ("s0", "s1", "s2")} == pytest.approx({"s0": 125, "s1": 50, "s2": 25}, abs=12)
    many = [(7, "same words " * 20, "a")] * 100 + [(i, "w " * 90, "b") for i in range(50)]
    words = sum(len(r.text.split()) for r in whole_documents(docs(spark, many)).collect() if r.source == "a")
    assert words == pytest.approx(targets({"a": 4000, "b": 4500})["a"], rel=0.02)


def test_plan_is_native(spark):
    plan = op4(docs(spark, CASES["even"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
