"""Exact top-k search by inner product: columnar branch and bound.

Vectors are kept in vertical layout, a block of them as one array per dimension.  For a block of
queries and a block of candidates, scores are accumulated over one block of dimensions after the
other.  What the remaining dimensions can still add is at most the product of the remaining
norms; pairs whose score so far plus that bound stays below the query's k-th best are dropped,
and once few pairs survive they are compacted and carried on by themselves.

Queries and candidates are dealt out over a grid of cells: a cell holds about ``CELL_BYTES`` of queries
and streams its candidates, block by block, and returns its k best per query; a window over those
picks the k best of all.  Every block of candidates goes to each strip of queries, so strips are as
long as memory allows.  Blocks come in order of their largest norm, so that bounds are tight early,
and a block whose norms can't reach any query's k-th best is passed over whole.  Copies of one
vector spread over the blocks like others.

Defined cases: a null id, a null vector, or one with null or non-finite components takes no part, nor
does one with components beyond whole numbers of 64 bits when scaled; vectors of different lengths are not compared; rows that repeat an id are separate queries and
candidates; fewer than k candidates give all; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

K = 20
SCALE = 64
#: Vectors in a block, and bytes of queries in a cell.
BLOCK = 1024
CELL_BYTES = 32 << 20
QUERY_STRIP = 256
DIM_BLOCK = 16
#: Surviving share of a strip's pairs below which they are compacted.
COMPACT_BELOW = 0.1


def pack(vectors: DataFrame, query_every: int, scale: int = SCALE) -> DataFrame:
    """Blocks: query, block, dim, n, norm (the largest), ids, rows (row keys), columns (int64, dimension by dimension)."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[bool, int], list[tuple[int, int, np.ndarray]]] = {}

        def emit(key: tuple[bool, int]) -> pd.DataFrame:
            rows = held.pop(key)
            ids, keys, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            return pd.DataFrame({"query": [key[0]], "block": [int(keys[0])], "dim": [key[1]], "n": [len(rows)], "norm": [float(np.sqrt((data.astype(np.float64) ** 2).sum(axis=1).max()))], "ids": [ids.tobytes()], "rows": [keys.tobytes()], "columns": [np.ascontiguousarray(data.T).tobytes()]})

        for pdf in batches:
            for vec_id, row, vector in zip(pdf["vec_id"].to_numpy(), pdf["row"].to_numpy(), pdf["embedding"]):
                x = np.array(vector, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                whole = np.floor(scale * x)
                if (np.abs(whole) >= 2.0**63).any():
                    continue
                whole = whole.astype(np.int64)
                for query in (False, True) if vec_id % query_every == 0 else (False,):
                    group = held.setdefault((query, len(whole)), [])
                    group.append((int(vec_id), int(row), whole))
                    if len(group) == BLOCK:
                        yield emit((query, len(whole)))
        for key in list(held):
            yield emit(key)

    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), "embedding").filter("vec_id is not null and embedding is not null")
    return found.mapInPandas(blocks, "query boolean, block long, dim int, n int, norm double, ids binary, rows binary, columns binary")


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.q, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.zeros(len(self.least), bool)
        touched[q] = True
        mine = touched[self.q]
        aq, ai, a_s = np.concatenate([self.q[mine], q]), np.concatenate([self.ids[mine], ids]), np.concatenate([self.scores[mine], scores])
        order = np.lexsort((ai, -a_s, aq))
        aq, ai, a_s = aq[order], ai[order], a_s[order]
        first = np.flatnonzero(np.r_[True, aq[1:] != aq[:-1]])
        rank = np.arange(len(aq)) - np.repeat(first, np.diff(np.r_[first, len(aq)]))
        full = rank == self.k - 1
        self.least[aq[full]] = a_s[full]
        top = rank < self.k
        self.q, self.ids, self.scores = np.concatenate([self.q[~mine], aq[top]]), np.concatenate([self.ids[~mine], ai[top]]), np.concatenate([self.scores[~mine], a_s[top]])


def search_block(best: Best, queries: np.ndarray, query_rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: np.dtype) -> None:
    """Bring one block of candidates (dimensions x n) to all queries (dimensions x m) of a cell.
    ``exact`` is a type that holds every score without loss."""
    dims, m = queries.shape
    cuts = list(range(0, dims, DIM_BLOCK)) + [dims]
    qs, cs = queries.astype(exact), columns.astype(exact)
    rest = lambda a, lo: np.sqrt((a[lo:].astype(np.float64) ** 2).sum(axis=0))
    q_rest, c_rest = [rest(queries, c) for c in cuts], [rest(columns, c) for c in cuts]
    for lo in range(0, m, QUERY_STRIP):
        hi = min(m, lo + QUERY_STRIP)
        least = best.least[lo:hi]
        if (q_rest[0][lo:hi] * c_rest[0].max(initial=0.0) * (1 + 1e-9) + 1e-3 < least).all():
            continue  # nothing in the block can be among the best
        score = np.zeros((hi - lo, columns.shape[1]), exact)
        at = pairs = None
        for step in range(len(cuts) - 1):
            score += qs[cuts[step] : cuts[step + 1], lo:hi].T @ cs[cuts[step] : cuts[step + 1]]
            if step + 2 < len(cuts) and np.isfinite(least).any():
                bound = np.multiply.outer(q_rest[step + 1][lo:hi], c_rest[step + 1])
                alive = score + (bound * (1 + 1e-9) + 1e-3) >= least[:, None]
                if np.count_nonzero(alive) < COMPACT_BELOW * alive.size:
                    at, pairs = step + 1, np.nonzero(alive)
                    break
        if pairs is None:
            reach = least
            if score.shape[1] > best.k + 1:
                # The k + 1 best of the block suffice: one of them may be the query itself.
                reach = np.maximum(least, np.partition(score, score.shape[1] - best.k - 1, axis=1)[:, score.shape[1] - best.k - 1].astype(np.float64))
            q, c = np.nonzero(score >= reach[:, None])
            s = score[q, c]
        else:
            q, c = pairs
            s = score[q, c]
            for step in range(at, len(cuts) - 1):
                for d in range(cuts[step], cuts[step + 1]):
                    s = s + qs[d, lo + q] * cs[d, c]
                go = s + (q_rest[step + 1][lo + q] * c_rest[step + 1][c] * (1 + 1e-9) + 1e-3) >= least[q]
                q, c, s = q[go], c[go], s[go]
        other = rows[c] != query_rows[lo + q]
        best.add(lo + q[other], ids[c[other]], s[other].astype(np.int64))


def exact_type(a: int, b: int, dims: int) -> np.dtype:
    """float64 while sums of products of such sizes are exact in it, then int64, then whole numbers
    without bound."""
    most = a * b * max(dims, 1)
    return np.dtype(np.float64) if most < 2**53 else np.dtype(np.int64) if most < 2**63 else np.dtype(object)


def _cells(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, state = None, None

        def close() -> pd.DataFrame:
            ids, rows, best = state["ids"], state["rows"], state["best"]
            return pd.DataFrame({"query_id": ids[best.q], "query_row": rows[best.q], "vec_id": best.ids, "score": best.scores})

        for pdf in batches:
            for c, query, dim, n, ids, rows, columns in zip(pdf["cell"], pdf["query"], pdf["dim"], pdf["n"], pdf["ids"], pdf["rows"], pdf["columns"]):
                if c != cell:
                    if state and "best" in state:
                        yield close()
                    cell, state = c, {"parts": []}
                ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
                columns = np.frombuffer(columns, np.int64).reshape(dim, n)
                if query:
                    state["parts"].append((ids, rows, columns))
                    continue
                if not state["parts"]:
                    continue
                if "best" not in state:
                    state |= {"ids": np.concatenate([p[0] for p in state["parts"]]), "rows": np.concatenate([p[1] for p in state["parts"]]), "columns": np.concatenate([p[2] for p in state["parts"]], axis=1)}
                    # Dimensions in order of the queries' energy: bounds tighten sooner.
                    state["order"] = np.argsort(-(state["columns"].astype(np.float64) ** 2).sum(axis=1), kind="stable")
                    state["columns"] = state["columns"][state["order"]]
                    state["best"], state["most"] = Best(len(state["ids"]), k), int(np.abs(state["columns"]).max(initial=0))
                exact = exact_type(state["most"], int(np.abs(columns).max(initial=0)), dim)
                search_block(state["best"], state["columns"], state["rows"], columns[state["order"]], ids, rows, exact)
        if state and "best" in state:
            yield close()

    return search


def top_k(vectors: DataFrame, query_every: int, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    packed = settle(pack(vectors, query_every, scale), "vector-blocks")
    sizes = {r["dim"]: r for r in packed.groupBy("dim").agg(F.sum(F.when(F.col("query"), F.col("n")).otherwise(0)).alias("m"), F.count(F.lit(1)).alias("b")).collect()}
    most = max((r["m"] * 8 * max(1, r["dim"]) for r in sizes.values()), default=0)
    strips = max(1, -(-most // CELL_BYTES))
    groups = max(1, min(max((r["b"] for r in sizes.values()), default=1), -(-2 * spark.sparkContext.defaultParallelism // strips)))
    hashed = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = packed.filter("query").withColumn("strip", hashed(strips)).withColumn("group", every(groups))
    others = packed.filter("not query").withColumn("group", hashed(groups)).withColumn("strip", every(strips))
    cells = queries.unionByName(others).withColumn("cell", F.concat_ws("/", "dim", "strip", "group"))
    dealt = cells.repartition(max(1, strips * groups), "cell").sortWithinPartitions("cell", F.col("query").desc(), F.col("norm").desc(), "block")
    part = dealt.select("cell", "query", "dim", "n", "ids", "rows", "columns").mapInPandas(_cells(k), "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, 20)
