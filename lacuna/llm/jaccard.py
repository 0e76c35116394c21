"""Self-join of texts by the Jaccard similarity of their word five-grams: chosen paths.

Every run grows a tree: a document goes from a node to the children of the shared tokens (shingles)
that a hash of the node picks, each with chance 1 / (threshold * set size).  Similar sets stay
together on some path, unlike ones part.  The first ``DEPTH`` levels need nothing but the document
itself; nodes that still hold more than ``LIMIT`` documents are split further, those of every run
by themselves, while that makes them smaller, and every node left is compared by brute force,
exactly.  ``RUNS`` runs follow from
the target recall: a pair right at the threshold, one set inside the other, survives a run of
depth d with the chance of a critical branching process (1 - q_d; q_0 = 0, q_d = exp(q_(d-1) - 1)),
so runs are repeated until the pair is missed with a chance below 1 - ``RECALL``.  As a pair parts
more often in nodes that are split down to ``MAX_DEPTH``, the documents of split nodes, and only
they, take part in further runs (``runs_for_split``), so that this chance holds for them too.

Rows with equal sets are one class from the start, whatever their doc_ids.  Every class has a number
of its own, by which nodes, blocks, links and components know it, and appears once, with its
count, so copies are never compared with each other.  Classes of large nodes are dealt into blocks of
about ``BLOCK`` sets or ``BLOCK_TOKENS`` tokens by the node that holds most of their likes; a pair of
blocks that meets in any node of any run is compared once, by one task, which returns a row per
class: its links there and the least class it is tied to.  Pairs are not written out.  A group of
near copies that differ from each other is still compared in full, block by block: tasks grow with
the square of its blocks, as the count of links asks for.

Words are runs of other characters than ASCII white space, as they stand; a text of one to four
words is a single shingle.

Defined cases: texts without words (null, empty, blank) link to nothing and are components of their
own.  Rows that share a doc_id are rows of their own, linked by their texts alone; rows without a
doc_id count and link like others.  ``class_id`` is the least doc_id of a component, null if no row
of it has one; where unrelated texts share a doc_id, ``class_key`` (the least set key of a
component, null without words) still tells their components apart.  Ties (similarity exactly at the
threshold) are links; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_by_size, release, settle

WORDS = 5
#: The threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
RECALL = 0.9995
DEPTH, MAX_DEPTH = 3, 8
BLOCK, BLOCK_TOKENS = 1024, 1 << 19
#: A node of a few blocks is compared as it stands: a document there meets 2,048 others on average, which
#: takes about as long as its sketch, and less than the further runs that a split would ask for.
LIMIT = 4 * BLOCK
#: Bytes of tokens that a partition of the comparison gets.
TASK_BYTES = 32 << 20
#: A node is not split further once a child keeps more than this share of its documents.
SHRINK = 0.7
WORDS_KEPT = 150_000
#: Hashes of nodes by tokens worked out at a time.
CELLS = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def miss(depth: int) -> float:
    """The chance that a pair at the threshold parts in one run of ``depth`` levels."""
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1)
    return q


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has been together in a node with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(miss(depth)))


def runs_for_split(recall: float = RECALL) -> int:
    """Runs, the first ones included, for the documents of split nodes: what the first ones miss at
    ``DEPTH`` and what all of them miss at ``MAX_DEPTH`` are together below 1 - ``recall``."""
    first = runs_for(recall)
    left = max(1 - recall - miss(DEPTH) ** first, 1e-12)
    return max(first, math.ceil(math.log(left) / math.log(miss(MAX_DEPTH))))


class Shingler:
    """Distinct hashed shingles of a text; remembers the hashes of words."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.known, self.hash = words, {}, xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        ws = _WORD.findall(text) if text else []
        known = self.known
        try:
            h = np.array([known[w] for w in ws], np.uint64)
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = self.hash(w.encode("utf-8", "surrogatepass"))
            h = np.array([known[w] for w in ws], np.uint64)
        if not len(h):
            return h
        k = min(self.words, len(h))
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            out = np.full(n, k, np.uint64)
            for j in range(k):
                out = mix(out * _C + h[j : j + n])
        return np.unique(out)


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return int(mix(tokens + _C).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(tokens * _B + _A), initial=np.uint64(0)).astype(np.int64))


def _picks(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children, over all ``nodes``, that a set goes on to, and the places of their parents."""
    chance = DENOMINATOR / (NUMERATOR * len(tokens))
    most, step = np.uint64(min(2**64 - 1, int(chance * 2.0**64))), max(1, CELLS // len(tokens))
    places, children = [], []
    with np.errstate(over="ignore"):
        for lo in range(0, len(nodes), step):
            node, token = np.nonzero(mix(tokens[None, :] ^ nodes[lo : lo + step, None]) <= most)
            places.append(node + lo)
            children.append(mix(mix(nodes[node + lo] + _C) ^ tokens[token]))
    return np.concatenate(places), np.concatenate(children)


def _children(tokens: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return _picks(tokens, nodes)[1]


def paths(tokens: np.ndarray, runs: int, depth: int = DEPTH, first: int = 0) -> np.ndarray:
    """The nodes at ``depth``, over the runs from ``first`` to ``runs``, that a set reaches."""
    with np.errstate(over="ignore"):
        nodes = mix((np.arange(first, runs, dtype=np.uint64) + np.uint64(1)) * _C)
    for _ in range(depth):
        if not len(nodes) or not len(tokens):
            return nodes[:0]
        nodes = _children(tokens, nodes)
    return np.unique(nodes)


def _sketch(runs: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingle = Shingler()
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            tokens = shingle(text)
            rows.append((*set_key(tokens), len(tokens), paths(tokens, runs).view(np.int64)))
        out = pdf[["none", "who", "t1", "t2"]].copy()
        out["k1"], out["k2"], out["n"] = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        out["nodes"] = [r[3] for r in rows]
        yield out
    shingle.known.clear()
    give_back()


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Token sets of classes, from a text of each."""
    shingle = Shingler()
    for pdf in batches:
        for lo in range(0, len(pdf), 1000):
            part = pdf.iloc[lo : lo + 1000]
            yield pd.DataFrame({"cls": part["cls"], "deep": part["deep"], "m": part["m"], "n": part["n"], "tokens": [shingle(t).tobytes() for t in part["text"]]})
    shingle.known.clear()
    give_back()


def _more(first: int, runs: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of further runs: rows of (cls, tokens) to rows of (node, cls)."""
    for pdf in batches:
        for lo in range(0, len(pdf), 1000):
            part = pdf.iloc[lo : lo + 1000]
            nodes = [paths(np.frombuffer(t, np.uint64), runs, first=first).view(np.int64) for t in part["tokens"]]
            yield pd.DataFrame({"node": np.concatenate([np.empty(0, np.int64), *nodes]), "cls": np.repeat(part["cls"].to_numpy(np.int64), [len(n) for n in nodes])})


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A level further: rows of (cls, its nodes, their sizes, tokens) to rows of children."""
    for pdf in batches:
        for lo in range(0, len(pdf), 1000):
            part = pdf.iloc[lo : lo + 1000]
            node, size, cls = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for c, ns, sizes, t in zip(part["cls"], part["nodes"], part["sizes"], part["tokens"]):
                places, own = _picks(np.frombuffer(t, np.uint64), np.array(ns, np.int64).view(np.uint64))
                node.append(own.view(np.int64))
                size.append(np.array(sizes, np.int64)[places])
                cls.append(np.full(len(own), c, np.int64))
            yield pd.DataFrame({"node": np.concatenate(node), "parent": np.concatenate(size), "cls": np.concatenate(cls)})


def compare(sizes: np.ndarray, tokens: list[np.ndarray], cut: int | None) -> np.ndarray:
    """Which sets are similar: the first ``cut`` against the others, or all against all."""
    d = len(tokens)
    owner = np.repeat(np.arange(d), sizes)
    _, ids, seen = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = seen[ids] > 1
    new = np.cumsum(seen > 1) - 1
    ids, owner = new[ids[shared]], owner[shared]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    n = int(ids[-1]) + 1 if len(ids) else 0
    lo_side, hi_side = (slice(0, d), slice(0, d)) if cut is None else (slice(0, cut), slice(cut, d))
    common = np.zeros((lo_side.stop, d - (hi_side.start or 0)), np.float32)
    width = 4096
    edges = np.searchsorted(ids, np.arange(0, n + width, width))
    for k in range(len(edges) - 1):
        i = slice(edges[k], edges[k + 1])
        if edges[k] == edges[k + 1]:
            continue
        dense = np.zeros((d, min(width, n - k * width)), np.float32)
        dense[owner[i], ids[i] - k * width] = 1
        common += dense[lo_side] @ dense[hi_side].T
    whole = sizes[lo_side][:, None] + sizes[hi_side][None, :]
    # common / (whole - common) >= a / b, in whole numbers
    alike = (NUMERATOR + DENOMINATOR) * common.astype(np.int64) >= NUMERATOR * whole
    if cut is None:
        np.fill_diagonal(alike, False)
    return alike


def _brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare the classes of each task (rows come task by task): cls, other, links."""
    held: list[tuple] = []
    task = None

    def close() -> pd.DataFrame | None:
        if len(held) < 2:
            return None
        first = held[0][0]
        rows = sorted(held, key=lambda r: r[0] != first)
        blocks = [r[0] for r in rows]
        cut = sum(b == first for b in blocks)
        cut = None if cut == len(rows) else cut
        own, m, sizes = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        alike = compare(sizes, [np.frombuffer(r[4], np.uint64) for r in rows], cut)
        if cut is not None:
            full = np.zeros((len(rows), len(rows)), bool)
            full[:cut, cut:], full[cut:, :cut] = alike, alike.T
            alike = full
        linked = np.flatnonzero(alike.any(axis=1))
        if not len(linked):
            return None
        near = alike[np.ix_(linked, linked)]
        label = own[linked].copy()
        while True:
            least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == label).all():
                break
            label = least
        return pd.DataFrame({"cls": own[linked], "other": label, "links": near.astype(np.int64) @ m[linked]})

    for pdf in batches:
        for t, b, cls, m, n, tokens in zip(pdf["task"], pdf["block"], pdf["cls"], pdf["m"], pdf["n"], pdf["tokens"]):
            if t != task:
                if (out := close()) is not None:
                    yield out
                held, task = [], t
            held.append((b, cls, m, n, tokens))
    if (out := close()) is not None:
        yield out


def components(edges: DataFrame) -> DataFrame:
    """node, least: the least node of each connected component (columns a, b; any direction).

    Large stars and small stars in turn; the number of rounds grows with the logarithm of the
    largest component, and each is written out.
    """
    now, was = settle(edges.select("a", "b").filter("a <> b").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == was or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("least"))
        was = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(floor.select("a", "m"))
        before, now = now, settle(small.filter("x <> y").distinct().toDF("a", "b"), "edges")
        release(before)


def _nodes(rows: DataFrame, leaf: Column) -> DataFrame:
    """Nodes of two classes or more, with those: node, size, cls, done.  A class has a node once.

    Of leaves (``leaf``, over size and parent, the parent's size) with the same classes one is
    kept.  Nodes to be split all stay: those of other runs with the same classes are other draws."""
    own = [F.max("parent").alias("parent")] if "parent" in rows.columns else []
    sums = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cls")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("s2"), *own)
    sums = sums.filter("size > 1").select("node", "size", "s1", "s2", leaf.alias("done"))
    kept = sums.groupBy("size", "s1", "s2", "done", F.when(~F.col("done"), F.col("node")).alias("apart")).agg(F.min("node").alias("node"))
    return rows.join(kept, "node").select("node", "size", "cls", "done")


KEY = ["none", "who", "t1", "t2"]


def _key() -> list[Column]:
    """KEY of a document: its doc_id (``none``: it is null) and 128 bits that tell texts apart."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("who"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _search(docs: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows of documents (none, who, k1, k2, n, ...) and the classes of those with words: k1, k2,
    m (rows), first (KEY of its first row), group (component), links (rows of other classes)."""
    spark, runs = docs.sparkSession, runs_for(recall)
    keyed = docs.select(*_key(), "text")
    sketch = settle(keyed.mapInPandas(partial(_sketch, runs), "none boolean, who long, t1 long, t2 long, k1 long, k2 long, n long, nodes array<long>"), "sketches")
    alike = sketch.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct(*KEY)).alias("first"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("nodes").alias("nodes"))
    # The table is written, so every class keeps the number that it gets here.
    classes = settle(alike.withColumn("cls", F.monotonically_increasing_id()), "classes")

    rows = settle(_nodes(classes.select("cls", F.explode("nodes").alias("node")), F.col("size") <= LIMIT), "nodes")
    # The classes of nodes that will be split (deep) are told apart before their tokens are written, so
    # that splitting shuffles the tokens of those alone.
    live = rows.groupBy("cls").agg(F.max(~F.col("done")).alias("deep"))
    known = classes.join(live, "cls").select("cls", "deep", "m", "n", *[F.col("first")[c].alias(c) for c in KEY])
    # Whole repeated rows are merged before they are shuffled.
    texts = keyed.groupBy(*KEY).agg(F.first("text").alias("text")).join(known, KEY)
    sets = settle(texts.select("cls", "deep", "m", "n", "text").mapInPandas(_sets, "cls long, deep boolean, m long, n long, tokens binary"), "sets")
    deep = sets.filter("deep").select("cls", "tokens")

    leaves, used = [rows.filter("done")], [rows, sets]
    large = rows.filter("not done")
    if not large.isEmpty():
        # Split nodes part more pairs: their classes take part in further runs.
        more = settle(deep.mapInPandas(partial(_more, runs, runs_for_split(recall)), "node long, cls long"), "nodes")
        further = settle(_nodes(more, F.col("size") <= LIMIT), "nodes")
        release(more)
        used.append(further)
        leaves.append(further.filter("done"))
        large = large.union(further.filter("not done"))
    for depth in range(DEPTH + 1, MAX_DEPTH + 1):
        if large.isEmpty():
            break
        held = large.groupBy("cls").agg(F.collect_list("node").alias("nodes"), F.collect_list("size").alias("sizes"))
        split = settle(held.join(deep, "cls").mapInPandas(_split, "node long, parent long, cls long").distinct(), "nodes")
        below = settle(_nodes(split, (F.col("size") <= LIMIT) | (F.col("size") > SHRINK * F.col("parent")) | F.lit(depth == MAX_DEPTH)), "nodes")
        release(split)
        used.append(below)
        leaves.append(below.filter("done"))
        large = below.filter("not done")
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.union(more)
    leaf = leaf.drop("done")

    # A class's home is the largest node that holds it; then each node is led by the home of most of
    # its classes, and they move to the leading home with the most votes.  So the many nodes of one
    # large group share a home, and its blocks are full.
    home = leaf.groupBy("cls").agg(F.max(F.struct("size", "node")).alias("h")).select("cls", F.col("h.node").alias("home"))
    votes = leaf.join(home, "cls").groupBy("node", "home").agg(F.count(F.lit(1)).alias("n"))
    lead = votes.groupBy("node").agg(F.max(F.struct("n", "home")).alias("lead"))
    moved = leaf.join(lead, "node").groupBy("cls").agg(F.max("lead").alias("lead")).select("cls", F.col("lead.home").alias("home"))
    moved = settle(moved.join(sets.select("cls", "n"), "cls"), "homes")
    filled = moved.join(moved.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks")), "home")
    at = settle(filled.select("cls", F.xxhash64("home", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("block"), "n"), "blocks")
    meet = leaf.join(at, "cls").select("node", "block").distinct()
    tasks = meet.join(meet.select("node", F.col("block").alias("other")), "node").filter("block <= other").select("block", "other").distinct()
    sides = settle(tasks.select(F.xxhash64("block", "other").alias("task"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block")), "tasks")
    tokens = sides.join(at.groupBy("block").agg(F.sum("n").alias("n")), "block").agg(F.sum("n")).first()[0] or 0
    dealt = sides.join(at.select("cls", "block"), "block").join(sets, "cls").select("task", "block", "cls", "m", "n", "tokens")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * tokens // TASK_BYTES))
    found = settle(dealt.repartition(width, "task").sortWithinPartitions("task", "block", "cls").mapInPandas(_brute, "cls long, other long, links long"), "links")
    release(at, moved, sides, *used)

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    least = components(found.select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cls")
    out = classes.select("cls", "k1", "k2", "m", "first").join(links, "cls", "left").join(least, "cls", "left")
    return sketch, settle(out.select("k1", "k2", "m", "first", F.coalesce("least", "cls").alias("group"), F.coalesce("links", F.lit(0)).alias("links")), "groups")


def similar(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, class_key for documents (doc_id, text).

    ``class_id`` is the least doc_id of a document's connected component, ``n_links`` the number of
    other rows at or above the threshold, ``n_copies`` how many have the very same set."""
    sketch, classes = _search(docs, recall)
    first = F.struct("first.none", "first.who")
    heads = classes.groupBy("group").agg(F.min(first).alias("head"), F.min("k1").alias("class_key"), F.count(F.lit(1)).alias("held"))
    named = join_by_size(classes, heads, ["group"], "held", classes.count())
    of = named.select("k1", "k2", "m", "class_key", F.when(~F.col("head.none"), F.col("head.who")).alias("class_id"), (F.col("m") - 1 + F.col("links")).alias("n_links"))
    own = F.when(~F.col("none"), F.col("who")).alias("doc_id")
    worded = sketch.filter("n > 0").select(own, "k1", "k2")
    blank = sketch.filter("n = 0").select(own, own.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("class_key"))
    out = join_by_size(worded, of, ["k1", "k2"], "m", worded.count())
    return out.select("doc_id", "class_id", "n_links", F.col("m").alias("n_copies"), "class_key").unionByName(blank)


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row of each component: that with the least doc_id (null ones last), of those the one whose
    text has the least hash.  Rows without words stay, all of them."""
    _, classes = _search(docs, recall)
    heads = classes.groupBy("group").agg(F.min("first").alias("head")).select(*[F.col("head")[c].alias(c) for c in KEY])
    # Rows alike in doc_id and text differ in other columns at most: the least hash of those decides.
    told = [F.col(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(worded).select(*_key(), F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.xxhash64(*told).alias("order"))
    single = rows.groupBy(*KEY).agg(F.min_by("row", "order").alias("row")).join(heads, KEY, "left_semi")
    return single.select("row.*").unionByName(docs.filter(~worded))


def op8(docs: DataFrame) -> DataFrame:
    return similar(docs)
