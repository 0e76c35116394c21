"""The three interval plans against brute force."""

import random

import pytest

from lacuna.operators import in_synteny, marked, side, unique
from lacuna.operators.overlap import PLANS
from lacuna.streaming import stream_unique

TE = "k int, chr string, te_start int, te_end int"
BLOCK = "chr string, b_start int, b_end int"


def brute(elements, blocks):
    return sorted(k for k, c, s, e in elements if not any(c == bc and bs <= e and be >= s for bc, bs, be in blocks))


CASES = {
    "touching": ([(1, "a", 1, 10)], [("a", 10, 20)]),
    "beside": ([(1, "a", 1, 10)], [("a", 11, 20)]),
    "other chromosome": ([(1, "a", 1, 10)], [("b", 1, 10)]),
    "inverted": ([(1, "a", 101, 100), (2, "a", 101, 100)], [("a", 100, 101), ("a", 101, 200)]),
    "inverted alone": ([(1, "a", 101, 100)], [("a", 101, 200)]),
    "no blocks": ([(1, "a", 1, 10), (1, "a", 1, 10)], []),
    "no elements": ([], [("a", 1, 2)]),
    "repeated": ([(1, "a", 1, 10)] * 3, [("a", 30, 40)] * 2),
    "negative": ([(1, "a", -5, -1), (2, "a", 0, 3)], [("a", -9, -4)]),
    "same end": ([(i, "a", i, 50) for i in range(60)], [("a", 0, 20), ("a", 10, 12)]),
}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("case", CASES)
def test_cases(spark, plan, case):
    elements, blocks = CASES[case]
    e, b = spark.createDataFrame(elements, TE), spark.createDataFrame(blocks, BLOCK)
    assert sorted(r.k for r in unique(e, b, plan).collect()) == brute(elements, blocks)
    assert sorted(r.k for r in in_synteny(e, b, plan).collect()) == sorted(x[0] for x in elements if x[0] not in brute(elements, blocks))
    assert sorted(r.k for r in marked(e, b).filter("not hit").collect()) == brute(elements, blocks)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("seed", range(3))
def test_random(spark, plan, seed):
    r = random.Random(seed)
    elements = [(k, r.choice("abc"), s := r.randrange(400), s + r.randrange(-3, 12)) for k in range(300)]
    blocks = [(r.choice("ab"), s := r.randrange(400), s + r.randrange(9)) for _ in range(60)]
    e, b = spark.createDataFrame(elements, TE), spark.createDataFrame(blocks, BLOCK)
    assert sorted(x.k for x in unique(e, b, plan).collect()) == brute(elements, blocks)


def test_auto_checks_the_size(spark, monkeypatch):
    from lacuna.operators import overlap

    e, b = spark.createDataFrame([(1, "a", 1, 2)], TE), spark.createDataFrame([("a", i * 10 + 5, i * 10 + 6) for i in range(50)], BLOCK)
    assert "BroadcastHashJoin" in unique(e, b)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(overlap, "BROADCAST_PER_CHR", 10)
    used = []
    monkeypatch.setitem(overlap.PLANS, "sweep", lambda *a: used.append(1) or overlap._sweep(*a))
    assert unique(e, b).count() == 1 and used


def test_broadcast_is_refused_for_many(spark, monkeypatch):
    """Asked for or not, more blocks than may be broadcast are swept."""
    from lacuna.operators import overlap

    monkeypatch.setattr(overlap, "BROADCAST_ROWS", 10)
    e, b = spark.createDataFrame([(1, "a", 1, 2)], TE), spark.createDataFrame([("a", i * 10 + 5, i * 10 + 6) for i in range(50)], BLOCK)
    assert "LeftAnti" not in unique(e, b, "broadcast")._jdf.queryExecution().executedPlan().toString()
    assert unique(e, b, "broadcast").count() == 1


def test_sweep_shuffles_elements_once(spark):
    e, b = spark.createDataFrame([(k, "a", k, k + 2) for k in range(99)], TE), spark.createDataFrame([("a", i * 10 + 5, i * 10 + 6) for i in range(5000)], BLOCK)
    plan = unique(e, b, "sweep")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and plan.count("Cartesian") == 0


def test_sides(spark):
    s = spark.createDataFrame([("a", 1, 2, "b", 3, 4)], "chr1 string, start1 int, end1 int, chr2 string, start2 int, end2 int")
    assert tuple(side(s, 1).first()) == ("a", 1, 2) and tuple(side(s, 2).first()) == ("b", 3, 4) and side(s, 3).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_stream_random(spark, tmp_path, monkeypatch, seed):
    from lacuna.operators import overlap

    monkeypatch.setattr(overlap, "BLOCKS_PER_BIN", 3)
    r = random.Random(seed)
    elements = [(k, r.choice("abc"), s := r.randrange(-50, 500), s + r.randrange(-3, 60)) for k in range(300)]
    blocks = [(r.choice("ab"), s := r.randrange(400), s + r.randrange(9)) for _ in range(40)] + [("a", 50, 50)] * 3
    spark.createDataFrame(elements, TE).write.parquet(str(tmp_path / "in"))
    q = stream_unique(spark.readStream.schema(TE).parquet(str(tmp_path / "in")), spark.createDataFrame(blocks, BLOCK)).writeStream.format("memory").queryName(f"found{seed}").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(x.k for x in spark.table(f"found{seed}").collect()) == brute(elements, blocks)


def test_stream(spark, tmp_path):
    elements = [(k, "a", k * 10, k * 10 + 4) for k in range(20)]
    blocks = spark.createDataFrame([("a", 52, 93)], BLOCK)
    spark.createDataFrame(elements, TE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TE).parquet(str(tmp_path / "in"))
    q = stream_unique(stream, blocks).writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("found").collect()) == brute(elements, [("a", 52, 93)])
