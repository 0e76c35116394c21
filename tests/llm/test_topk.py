"""Exact top-k against brute force."""

import numpy as np
import pytest

from lacuna.llm import topk
from lacuna.llm.topk import op7

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    kept = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x) < 2**57 for x in v)]
    out = []
    for a, (q, v) in enumerate(kept):
        if q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), c) for b, (c, w) in enumerate(kept) if b != a and len(w) == len(v))
        out += [(q, k, c, -s) for k, (s, c) in enumerate(scored[:20], 1)]
    return sorted(out)


def random_rows(n, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.normal(size=dims).astype(np.float32) * spread]) for i in range(n)]


CASES = {
    "plain": random_rows(400, 24, 1),
    "clustered": [(i, [float(np.float32(x + (i % 5))) for x in v]) for i, v in random_rows(500, 40, 2, 0.1)],
    "few": random_rows(7, 3, 3),
    "one": random_rows(1, 3, 3),
    "ties": [(i, [0.5, 0.25]) for i in range(100)],
    "repeated ids": random_rows(60, 5, 4) + random_rows(60, 5, 5),
    "nulls and odd numbers": [(20, None), (None, [1.0, 2.0]), (40, [1.0, float("nan")]), (60, [1.0, None]), (80, [float("inf"), 1.0]), (100, []), (0, [1.0, 1.0]), (3, [0.0, -1.0]), (5, [2.0, 2.0])],
    "mixed lengths": random_rows(50, 4, 6) + [(i + 100, v) for i, v in random_rows(50, 6, 7)],
    "large numbers": random_rows(80, 4, 8, 1e6),
    "beyond 64 bits": random_rows(40, 3, 10) + [(100, [3e18, 1.0, 1.0]), (120, [-1e30, 0.0, 0.0])],
    "hot vector": random_rows(100, 8, 9) + [(i + 100, [0.5] * 8) for i in range(300)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("block", [16, 1024])
def test_against_brute_force(spark, monkeypatch, case, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_STRIP", 8)
    rows = CASES[case]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "2 AS score").repartition(3)
    assert sorted(tuple(r) for r in op7(df).collect()) == brute(rows)


def test_empty(spark):
    assert op7(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("prune", [0.0, 1.1])
def test_both_branches(monkeypatch, prune):
    """With and without compaction the block search finds the same."""
    monkeypatch.setattr(topk, "COMPACT_BELOW", prune)
    r = np.random.default_rng(0)
    q, c = r.integers(-64, 64, (48, 10)), r.integers(-64, 64, (48, 900))
    best = topk.Best(10, 20)
    for lo in range(0, 900, 100):
        topk.search_block(best, q, np.full(10, -1), c[:, lo : lo + 100], np.arange(lo, lo + 100), np.arange(lo, lo + 100), np.dtype(np.float64))
    for k in range(10):
        s = q[:, k] @ c
        want = [(int(s[j]), int(j)) for j in np.lexsort((np.arange(900), -s))[:20]]
        mine = best.q == k
        assert sorted(zip(best.scores[mine].tolist(), best.ids[mine].tolist()), key=lambda x: (-x[0], x[1])) == want
