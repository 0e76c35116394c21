"""The permutation, and the shards."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm.sharding import SHARDS, assign, invert, op10, permute


@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    p = permute(np.arange(n), n, key)
    assert sorted(p.tolist()) == list(range(n)) and (invert(p, n, key) == np.arange(n)).all()


def test_it_shuffles():
    p = permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(p, np.arange(10_000))[0, 1]) < 0.05
    assert (permute(np.arange(100), 100, 1) != permute(np.arange(100), 100, 2)).any()


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000])
def test_law(spark, n):
    rows = [(k // 3, None if k % 5 == 0 else "é" * (k % 7)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS row", "3 AS tie").repartition(4)
    got = op10(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((k, len(b := (t or "").encode()) + 1, zlib.crc32(b)) for k, t in rows)
    counts = [sum(r.shard == s for r in got) for s in range(SHARDS)]
    assert max(counts) - min(counts) <= 1
    for s in range(SHARDS):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in got} <= {"rows"} and all(r.grown_shard is None for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, op10(docs.repartition(2)).collect()))


def test_repeated_rows(spark, monkeypatch):
    """A row that stands many times is numbered in parts, the same in every run, and takes its places."""
    from lacuna.llm import sharding

    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(1, "the same")] * 500 + [(None, None)] * 90 + [(k, "x" * k) for k in range(60)] + [(3, "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = assign(docs.repartition(5)).collect()
    assert sorted(r.row for r in got) == list(range(len(rows)))
    assert sorted(map(repr, got)) == sorted(map(repr, assign(docs.repartition(2)).collect()))


def test_places_are_computable(spark):
    docs = spark.createDataFrame([(k, str(k)) for k in range(500)] + [(None, None)], "doc_id long, text string")
    rows = assign(docs).collect()
    p = permute(np.array([r.row for r in rows]), 501)
    assert sorted(r.row for r in rows) == list(range(501))
    assert all((r.shard, r.slot) == (x % SHARDS, x // SHARDS) for r, x in zip(rows, p.tolist()))
