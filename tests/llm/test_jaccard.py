"""The chosen-path join against all pairs."""

import random
import re

import numpy as np
import pytest

from lacuna.llm import jaccard
from lacuna.llm.jaccard import _children, compare, components, one_of_each, op8, runs_for, set_key

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall(text or "")
    k = min(5, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def brute(rows):
    """class and links per row; components go by texts, whatever the ids."""
    sets = [shingles(t) for _, t in rows]
    n, links, group = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                group[find(a)] = find(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return ordered((rows[a][0], least.get(find(a)), links[a]) for a in range(n))


def ordered(rows):
    return sorted(rows, key=repr)


def found(docs):
    return ordered((r.doc_id, r.class_id, r.n_links) for r in op8(docs).collect())


def text(r, n, words=4000):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def edited(r, t, edits):
    ws = t.split()
    for _ in range(edits):
        ws[r.randrange(len(ws))] = f"e{r.randrange(10**6)}"
    return " ".join(ws)


def corpus(seed):
    r = random.Random(seed)
    base, passage = [text(r, r.choice([6, 40, 150, 300])) for _ in range(60)], text(r, 60)
    rows = base + [edited(r, t, r.choice([1, 2, 4])) for t in base for _ in range(3)] + base[:10] * 3
    rows += [passage + " " + text(r, 90) for _ in range(120)]
    heavy = text(r, 200)
    rows += [edited(r, heavy, 2) for _ in range(150)]
    rows += [None, "", " ", "a", "a", "a b c d", "a b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    monkeypatch.setattr(jaccard, "LIMIT", 16)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS n", "3 AS class_id").repartition(5)
    assert found(docs) == brute(rows)


@pytest.mark.parametrize("limit", [64, 4])
def test_repeated_and_null_ids(spark, monkeypatch, limit):
    """Ids that stand for several texts, or for none, neither lose links nor make any."""
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    r = random.Random(8)
    base = [text(r, n) for n in (8, 30, 60, 200, 3000, 60, 60, 60)]
    near = [t if len(t.split()) < 40 else edited(r, t, 1) for t in base]
    rows = [(k, t) for k in (1, 2, 3) for t in base] + [(k + 1, t) for k, t in enumerate(near)] + [(None, t) for t in base[2:] + near[2:]]
    rows += [(None, None), (None, ""), (1, None), (1, base[2]), (1, base[2]), (None, base[2])]
    rows += [(None, text(r, 50)), (None, text(r, 50)), (9, text(r, 50)), (9, text(r, 50))]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = op8(docs).collect()
    assert ordered((x.doc_id, x.class_id, x.n_links) for x in out) == brute(rows)
    assert len({x.class_key for x in out} - {None}) == len(base) + 4
    assert sum(x.class_key is None for x in out) == 3
    kept = one_of_each(docs).collect()
    assert len(kept) == len(base) + 4 + 3
    assert sum(not shingles(x.text) for x in kept) == 3
    sets = [shingles(x.text) for x in kept if shingles(x.text)]
    assert all(5 * len(a & b) < 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_blocks_are_bounded_by_tokens(spark, monkeypatch):
    """Long near copies are dealt into several blocks, and lose no links."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 2000)
    r = random.Random(9)
    body = text(r, 900)
    rows = list(enumerate(edited(r, body, 2) for _ in range(40)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_very_long_texts(spark):
    r = random.Random(10)
    long = text(r, 150_000, 10**6)
    rows = [(1, long), (2, edited(r, long, 9)), (3, text(r, 150_000, 10**6)), (4, "x" * 500_000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_large_groups_keep_their_links(spark, monkeypatch):
    """Groups of more than LIMIT texts with one body and differing tails: each run splits them anew."""
    monkeypatch.setattr(jaccard, "LIMIT", 64)
    r = random.Random(3)
    bodies = [text(r, 60) for _ in range(12)]
    rows = list(enumerate((f"{body} {text(r, 6, 10**6)}" for body in bodies for _ in range(70)), 1))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in op8(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == [(k, (k - 1) // 70 * 70 + 1, 69) for k, _ in rows]


def test_split_nodes_keep_the_recall(spark, monkeypatch):
    """Pairs at the threshold, one set inside the other, all of whose nodes are split to the last level."""
    monkeypatch.setattr(jaccard, "LIMIT", 1)
    monkeypatch.setattr(jaccard, "SHRINK", 1)
    r = random.Random(4)
    rows = []
    for k in range(400):
        ws = text(r, 104, 10**6).split()
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(ws[:84]))]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in op8(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == [(k, k // 2 * 2, 1) for k, _ in rows]
    for recall in (0.9, 0.9995):
        first = jaccard.miss(jaccard.DEPTH) ** runs_for(recall)
        assert first + jaccard.miss(jaccard.MAX_DEPTH) ** jaccard.runs_for_split(recall) <= 1 - recall


def test_splitting_takes_the_tokens_of_split_nodes_alone(spark, monkeypatch):
    """Further runs read their classes as written, without a join; a level joins those and no others."""
    monkeypatch.setattr(jaccard, "LIMIT", 64)
    plans, wrote = [], jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda df, what: (what == "nodes" and plans.append(df._jdf.queryExecution().optimizedPlan().toString()), wrote(df, what))[1])
    r = random.Random(5)
    body, near = text(r, 60), [text(r, 60) for _ in range(40)]
    rows = list(enumerate([f"{body} {text(r, 6, 10**6)}" for _ in range(70)] + [f"{t} {text(r, 2, 10**6)}" for t in near for _ in range(2)], 1))
    out = op8(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert ordered((x.doc_id, x.class_id, x.n_links) for x in out) == brute(rows)
    more, split = [p for p in plans if "MapInPandas" in p][:2]
    assert "Join" not in more and split.count("Join") == 1 and "deep" in more and "deep" in split


def test_odd_rows(spark):
    t = " ".join(f"x{i}" for i in range(50))
    docs = spark.createDataFrame([(7, t), (7, t), (None, t), (3, t), (None, "only here and nowhere else now"), (9, None), (10, "")], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in op8(docs).collect()}
    assert got == {(7, 3, 3, 4), (None, 3, 3, 4), (3, 3, 3, 4), (None, None, 0, 1), (9, 9, 0, 1), (10, 10, 0, 1)}
    assert op8(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in one_of_each(docs).collect()) == [0, 3, 9, 10]


def test_exact_threshold():
    """8 of 10 shared is a link, the next lower possible share is not."""
    a = np.arange(9, dtype=np.uint64)
    assert compare(np.array([9, 9]), [a, a + np.uint64(1)], None)[0, 1]
    assert not compare(np.array([9, 9]), [a, a + np.uint64(2)], None)[0, 1]
    assert compare(np.array([9, 9]), [a, a + np.uint64(1)], 1)[0, 0]


def test_runs_reach_the_recall():
    """Sets at the threshold meet in some node of a run as often as the process says."""
    r, met, trials = np.random.default_rng(0), 0, 400
    for k in range(trials):
        y = r.integers(0, 2**63, 100, dtype=np.uint64)
        x = y[:80]
        met += bool(set(jaccard.paths(x, 1).tolist()) & set(jaccard.paths(y, 1).tolist()))
    q = 1 - met / trials
    assert q ** runs_for() <= 0.003 and runs_for(0.9) < runs_for(0.999)
    assert len(_children(y, np.arange(1000, dtype=np.uint64))) == pytest.approx(1250, rel=0.15)


def test_keys():
    a = np.array([1, 2, 3], np.uint64)
    assert set_key(a) == set_key(a) != set_key(a[:2])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.least for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {101: 100, 102: 100}
