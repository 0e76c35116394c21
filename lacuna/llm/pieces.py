"""SentencePiece encoding by sampling, and decoding.

A text's lattice has an edge for every piece of the vocabulary that matches at a place, and an edge
of byte pieces where no piece matches.  Forward filtering gives every place the total weight of the
paths to it; sampling backwards from the end picks each edge with its share of that weight, so a
whole segmentation is drawn with its exact probability.  The random numbers are a hash of the
row's key and the place in the text: the same row always gets the same pieces, in whatever batch,
partition or attempt.

Pieces hold the space mark only at their start (or consist of it) and no line feed, which is checked
when a model is read, so nothing crosses from a character to a following space, nor a line feed.
The lattice therefore falls apart into chunks, long ones also wherever no piece that matches
crosses, and the lattice of a distinct chunk is built once.  All chunks of a batch are sampled
together, one piece of each at a step.  A long chunk that nowhere falls apart (one repeated letter,
say) is filtered a stripe of nodes at a time.

A piece's weight is 1 / rank**power, by its rank in the vocabulary.

Decoding joins pieces, turns space marks into spaces and byte pieces into characters; it gives
back every text exactly (a space mark in the text itself is encoded as bytes).

Defined cases: a null text has no pieces and decodes to the empty text, as does the empty text;
rows with equal keys and texts get equal pieces; a null key counts as 0; texts of any length are
encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, unused

SPACE = "▁"
POWER = 1.0
SEED = 17
#: Characters sampled together, and distinct chunks that a worker remembers within a task.
CHARS_AT_ONCE = 250_000
CHUNKS_KEPT = 100_000
#: Longest chunk whose lattice is built together with others.
VECTOR_CHARS = 40
#: Nodes of such chunks whose edges are laid out at once, a matrix row each.
NODES_AT_ONCE = 20_000
#: Nodes of a longer chunk that are filtered before their edges are put away.
STRIPE = 20_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class Pieces:
    """A model file's vocabulary, and the lattices built so far."""

    def __init__(self, path: str, power: float = POWER):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids, self.table, self.weight = {}, {}, [0.0] * len(self.names)
        rank = 0
        for i, name in enumerate(self.names):
            if (m := _BYTE.match(name)) and model.is_byte(i):
                self.byte_ids[int(m[1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                rank += 1
                self.weight[i] = 1.0 / (rank + 1) ** power
                for k in range(1, len(name)):
                    self.table.setdefault(name[:k], -1)
                self.table[name] = i
        if odd := [n for n in self.table if "\n" in n or re.search(rf"[^{SPACE}]{SPACE}", n)]:
            raise ValueError(f"pieces that go on behind a space or line feed: {odd[:3]}")
        self.rare = 1.0 / (rank + 2) ** power
        self.longest = max(map(len, self.table))
        # What a piece decodes to; bytes of ASCII characters are those, others need their neighbours.
        self.plain = [n.replace(SPACE, " ") for n in self.names]
        self.wide_bytes = {i: b for b, i in self.byte_ids.items() if b >= 0x80}
        for b, i in self.byte_ids.items():
            self.plain[i] = chr(b) if b < 0x80 else ""
        # A word ends a chunk unless some piece goes on from its last letter to what follows it.
        onward: dict[str, set[str]] = {}
        for a, b in {ab for n in self.table for ab in re.findall(r"(?=([^\W\d_])([\W\d_]))", n)}:
            onward.setdefault(b, set()).add(a)
        barred = "".join(f"|(?<=[{re.escape(''.join(sorted(a)))}]){re.escape(b)}" for b, a in sorted(onward.items()))
        word = rf" ?[A-Za-z]++(?![^\W\d_]{barred})| *[^\W\d_]++(?![^\W\d_]{barred})"  # the first is the quicker
        self.chunks = re.compile(rf"{word}| *[^ \n{SPACE}]+|\n| +|{SPACE}").findall
        self._build_trie()
        self.forget()

    def _build_trie(self) -> None:
        """The table as transitions between its prefixes: (state, character) -> state."""
        number = {"": 0} | {name: k for k, name in enumerate(self.table, 1)}
        steps = sorted((number[name[:-1]] << 21 | ord(name[-1]), k) for name, k in number.items() if name)
        self.steps, self.targets = np.array([x for x, _ in steps], np.int64), np.array([k for _, k in steps], np.int32)
        self.piece_at = np.array([-1, *self.table.values()], np.int32)
        self.weights = np.array([*self.weight, self.rare])  # -1, the bytes of a character, is the last

    def forget(self) -> None:
        """Drop all lattices.  Edges are in order of the node where they end, the longest first:
        the probability of a node's edges up to and with each, length, ids (the first of them).  The
        arrays have room behind the last of ``n_nodes`` and ``n_edges``."""
        self.ends: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0
        self.edges_from = np.zeros(1, np.int32)
        self.upto, self.length, self.first_id, self.n_ids = np.zeros(0, np.float32), np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(0, np.int8)
        self.extra: dict[int, list[int]] = {}

    def _drop(self, chunks: list[str], n_nodes: int, n_edges: int, n_extra: int) -> None:
        """Take back the chunks learned last."""
        for c in chunks:
            del self.ends[c]
        for _ in range(len(self.extra) - n_extra):
            self.extra.popitem()
        self.n_nodes, self.n_edges = n_nodes, n_edges

    def _put(self, name: str, at: int, parts: list[np.ndarray]) -> None:
        """Write into an array from a place on, and make room where it is short."""
        own, n = getattr(self, name), at + sum(map(len, parts))
        if n > len(own):
            own = np.concatenate([own[:at], np.empty(n + n // 8 - at, own.dtype)])
            setattr(self, name, own)
        for part in parts:
            own[at : at + len(part)] = part
            at += len(part)

    def learn(self, chunks: list[str]) -> None:
        """Build the lattices of new chunks.  A chunk of n characters has n + 1 nodes in a row."""
        short = [c for c in chunks if len(c) <= VECTOR_CHARS and c != SPACE]
        upto = np.cumsum(_lengths(short) + 1)
        cuts = [0, *np.searchsorted(upto, np.arange(NODES_AT_ONCE, upto[-1] if short else 0, NODES_AT_ONCE)).tolist(), len(short)]
        parts = [(short[a:b], self._many(short[a:b])) for a, b in zip(cuts, cuts[1:]) if a < b]
        parts += [([c], self._long(c)) for c in chunks if len(c) > VECTOR_CHARS or c == SPACE]
        n_nodes, n_edges = self.n_nodes, self.n_edges
        for held, (counts, _, _, _, _, extra) in parts:
            last = n_nodes - 1 + np.cumsum(_lengths(held) + 1)
            self.ends.update(zip(held, last.tolist()))
            self.extra |= {n_edges + e: own for e, own in extra.items()}
            n_nodes, n_edges = n_nodes + len(counts), n_edges + int(counts.sum())
        counts = np.concatenate([p[1][0] for p in parts])
        self._put("edges_from", self.n_nodes + 1, [self.n_edges + np.cumsum(counts, dtype=np.int64)])
        for k, name in enumerate(("upto", "length", "first_id", "n_ids"), 1):
            self._put(name, self.n_edges, [p[1][k] for p in parts])
        self.n_nodes, self.n_edges = n_nodes, n_edges

    def _edges(self, total: np.ndarray, weight: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> tuple:
        """Edges of nodes x lengths matrices; ids of -1 stand for the bytes of the character that ends
        at a node."""
        flow = weight[:, ::-1]
        there = flow > 0
        counts = there.sum(axis=1)
        upto = (np.cumsum(flow, axis=1) / np.where(total > 0, total, 1)[:, None])[there]
        upto[np.cumsum(counts)[counts > 0] - 1] = 2.0  # the last edge takes whatever is left
        node, column = np.nonzero(there)
        first = ids[:, ::-1][there]
        return counts, upto, weight.shape[1] - column, first, *self._spelled(first, node, codes)

    def _spelled(self, first: np.ndarray, node: np.ndarray, codes: np.ndarray, back: int = 0) -> tuple:
        """Put ids in the place of -1, the bytes of the character ``back`` places before an edge's node:
        the number of ids of each edge, and those of edges with several."""
        sizes, extra = np.ones(len(first), np.int8), {}
        for e in np.flatnonzero(first < 0).tolist():
            own = [self.byte_ids[b] for b in chr(codes[node[e] - back]).encode("utf-8", "surrogatepass")]
            first[e], sizes[e] = own[0], len(own)
            if len(own) > 1:
                extra[e] = own
        return sizes, extra

    def _many(self, chunks: list[str]) -> tuple:
        """Lattices of short chunks, all at once: walk the trie from every place, then filter forward
        one place of every chunk at a time, edge by edge."""
        sizes = _lengths(chunks) + 1
        starts = np.cumsum(sizes) - sizes
        codes = _codes("\n".join([*chunks, ""]))
        codes[starts + sizes - 1] = 0x110000  # no character: nothing crosses the end of a chunk
        width = self.longest
        # Whether there is an edge, and its id, by node and length, the longest first.
        there, ids = np.zeros(len(codes) * width, bool), np.empty(len(codes) * width, np.int32)
        at, state = np.flatnonzero(codes < 0x110000), None
        single = np.zeros(len(codes), bool)
        places = at
        for n in range(1, width + 1):
            key = codes[at + n - 1] if state is None else state.astype(np.int64) << 21 | codes[at + n - 1]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            ok = self.steps[k] == key
            at, state = at[ok], self.targets[k[ok]]
            v = self.piece_at[state]
            has = v >= 0
            slot = (at[has] + n) * width + width - n
            there[slot], ids[slot] = True, v[has]
            if n == 1:
                single[at[has]] = True
            if not len(at):
                break
        slot = (places[~single[places]] + 1) * width + width - 1
        there[slot], ids[slot] = True, -1
        slot = np.flatnonzero(there)
        node, first = slot // width, ids[slot]
        length = (node + 1) * width - slot
        counts = np.bincount(node, minlength=len(codes))
        # Every node but a chunk's first has an edge.  Those at one place of their chunks come together.
        place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint16)
        order = np.argsort(place[node], kind="stable")
        weight, source, target = self.weights[first][order], (node - length)[order], node[order]
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        target = target[heads]
        edges_to, nodes_to = np.cumsum(np.bincount(place[node])).tolist(), (np.cumsum(np.bincount(place)) - len(chunks)).tolist()
        total = np.zeros(len(codes))
        total[starts] = 1.0
        for j in range(1, len(nodes_to)):
            lo, hi, own = edges_to[j - 1], edges_to[j], slice(nodes_to[j - 1], nodes_to[j])
            weight[lo:hi] *= total[source[lo:hi]]
            total[target[own]] = np.add.reduceat(weight[lo:hi], heads[own] - lo)
        upto = np.empty(len(order))
        upto[order] = weight
        lead, more, k = np.cumsum(counts) - counts, np.flatnonzero(counts > 1), 1
        while len(more):
            edge = lead[more] + k
            upto[edge] += upto[edge - 1]
            k += 1
            more = more[counts[more] > k]
        upto /= total[node]
        upto[(lead + counts - 1)[counts > 0]] = 2.0  # the last edge takes whatever is left
        return counts, upto, length, first, *self._spelled(first, node, codes, 1)

    def _matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and ids of the pieces that end at each node of one chunk, by length; -1 for bytes."""
        width, n = self.longest, len(codes)
        weight, ids = np.zeros((n + 1, width)), np.zeros((n + 1, width), np.int32)
        at, state = np.arange(n), None
        single = np.zeros(n, bool)
        for k in range(1, width + 1):
            key = codes[at + k - 1] if state is None else state.astype(np.int64) << 21 | codes[at + k - 1]
            place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            ok = self.steps[place] == key
            at, state = at[ok], self.targets[place[ok]]
            v = self.piece_at[state]
            has = v >= 0
            weight[at[has] + k, k - 1], ids[at[has] + k, k - 1] = self.weights[v[has]], v[has]
            if k == 1:
                single[at[has]] = True
            go = at + k < n
            at, state = at[go], state[go]
            if not len(at):
                break
        odd = np.flatnonzero(~single)
        weight[odd + 1, 0], ids[odd + 1, 0] = self.rare, -1
        return weight, ids

    def parts(self, chunk: str) -> list[str]:
        """A long chunk cut wherever no piece that matches crosses."""
        if len(chunk) <= VECTOR_CHARS:
            return [chunk]
        codes, out, held = _codes(chunk), [], 0
        # A stripe begins at a cut, or as many characters as the longest piece before its first node.
        for lo in range(0, len(codes), STRIPE):
            begin, end = max(0, lo - self.longest), min(len(codes), lo + STRIPE + self.longest)
            weight, _ = self._matches(codes[begin:end])
            node, shorter = np.nonzero(weight)  # the length less one
            # An edge crosses the nodes between the one before it and the one behind it.
            crossed = np.zeros(end - begin + 2, np.int64)
            np.add.at(crossed, node - shorter, 1)
            np.add.at(crossed, node, -1)
            free = np.flatnonzero(np.cumsum(crossed)[: end - begin + 1] == 0) + begin
            for cut in free[(free > max(lo, held)) & (free <= min(lo + STRIPE, len(codes)))].tolist():
                out.append(chunk[held:cut])
                held = cut
        if held < len(chunk):
            out.append(chunk[held:])
        return out

    def _long(self, chunk: str) -> tuple:
        """The lattice of one chunk of any length; sums are scaled up before they vanish."""
        codes, width = _codes(chunk), self.longest
        if chunk == SPACE:
            codes = np.array([0x10FFFF], np.int64)  # the mark itself is spelled in bytes
        recent = np.zeros(width)  # sums of the last nodes, the last first
        recent[0] = 1.0
        done = [(np.zeros(1, np.int64), *(np.zeros(0) for _ in range(4)), {})]
        n_edges = 0
        for lo in range(0, len(codes), STRIPE):
            hi, begin = min(len(codes), lo + STRIPE), max(0, lo - width)
            weight, ids = self._matches(codes[begin:hi])
            weight, ids = weight[lo - begin + 1 :], ids[lo - begin + 1 :]
            for row in weight:
                row *= recent
                total = row.sum()
                row /= total
                recent[1:] = recent[:-1]
                recent[0] = total
                if total < 1e-100:  # only the nodes in reach matter, and only their proportions
                    recent *= 1e100
            seen = np.array([ord(SPACE)], np.int64) if chunk == SPACE else codes[lo:hi]
            counts, upto, length, first, sizes, extra = self._edges(np.ones(len(weight)), weight, ids, seen)
            done.append((counts, upto, length, first, sizes, {n_edges + e: own for e, own in extra.items()}))
            n_edges += len(upto)
        return (*(np.concatenate([d[k] for d in done]) for k in range(5)), {e: own for d in done for e, own in d[5].items()})

    def sample(self, keys: list[int], texts: list[str | None], seed: int = SEED) -> list[np.ndarray]:
        """The sampled ids of each text."""
        out: list[np.ndarray] = []
        lo, n = 0, 0
        for hi, text in enumerate(texts, 1):
            n += len(text or "")
            if n > CHARS_AT_ONCE or hi == len(texts):
                out += self._sample(keys[lo:hi], texts[lo:hi], seed)
                lo, n = hi, 0
        return out

    def _sample(self, keys: list[int], texts: list[str | None], seed: int) -> list[np.ndarray]:
        split = [self.chunks(f" {t}") if t else [] for t in texts]
        for cs in split:
            if cs and len(max(cs, key=len)) > VECTOR_CHARS:
                cs[:] = chain.from_iterable(map(self.parts, cs))
        ends = self.ends
        full, known = len(ends) >= CHUNKS_KEPT, (self.n_nodes, self.n_edges, len(self.extra))
        new = list(set().union(*split).difference(ends))
        if new:
            self.learn(new)
        counts = np.array([len(cs) for cs in split])
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        flat = list(chain.from_iterable(split))
        node = np.fromiter(map(ends.__getitem__, flat), np.int64, len(flat))
        length = _lengths(flat)
        place = np.cumsum(length)  # places in the batch; every text starts at its own
        with np.errstate(over="ignore"):
            salt = np.repeat(_mix(np.array([k % 2**64 for k in keys], np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) - starts[:-1].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), counts)
        stop = node - length
        order = np.argsort(node)  # like chunks together: their edges are read from the same place
        node, place, salt, stop = node[order], place[order], salt[order], stop[order]
        chosen = np.full(int(starts[-1]) + 1, -1, np.int32)
        while len(node):
            with np.errstate(over="ignore"):
                u = ((_mix(salt + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(40)) * 2.0**-24).astype(np.float32)
            edge = self.edges_from[node]
            more = np.flatnonzero(u >= self.upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.upto[edge[more]]]
            chosen[place] = edge
            step = self.length[edge].astype(np.int64)
            node, place = node - step, place - step
            go = node > stop
            node, place, salt, stop = node[go], place[go], salt[go], stop[go]
        at = np.flatnonzero(chosen >= 0)
        edges = chosen[at]
        ids, repeat = self.first_id[edges], self.n_ids[edges]
        per_text = np.searchsorted(at, starts[1:], "right")
        if (many := np.flatnonzero(repeat > 1)).size:
            run = np.cumsum(repeat, dtype=np.int64)
            ids = np.repeat(ids, repeat)
            for k in many.tolist():
                own = self.extra[int(edges[k])]
                ids[run[k] - len(own) : run[k]] = own
            per_text = np.r_[0, run][per_text]
        if full and new:  # the chunks known by then, frequent ones among them, stay
            self._drop(new, *known)
        return np.split(ids, per_text[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        ids, wide, plain = ids.tolist(), self.wide_bytes, self.plain
        if wide.keys().isdisjoint(ids):
            return "".join(map(plain.__getitem__, ids))[1:]
        data = b"".join([bytes((wide[i],)) if i in wide else plain[i].encode() for i in ids])
        return data[1:].decode("utf-8", "surrogatepass")


def _lengths(chunks: list[str]) -> np.ndarray:
    return np.fromiter(map(len, chunks), np.int64, len(chunks))


def _codes(chunk: str) -> np.ndarray:
    """Code points of a chunk, with space marks for spaces."""
    return np.frombuffer(chunk.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


_PIECES: dict[tuple[str, float], Pieces] = {}


def pieces_of(path: str, power: float = POWER) -> Pieces:
    """The process's pieces of a model: a worker reads the vocabulary once."""
    if (path, power) not in _PIECES:
        _PIECES[path, power] = Pieces(path, power)
    return _PIECES[path, power]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", into: str = "piece_ids", decoded: str | None = None, power: float = POWER, seed: int = SEED) -> DataFrame:
    """``docs`` with the sampled ids of every text; ``key`` is a whole number per row.  With
    ``decoded`` there is one more column: what these ids decode to, worked out in the same pass."""

    kept = [c for c in docs.columns if c not in (into, decoded)]
    source = docs.select(*[docs[c] for c in kept], docs[key].cast("long").alias(unused(docs, "_key")), docs[text].alias(unused(docs, "_text")))
    fields = [*source.schema.fields[: len(kept)], T.StructField(into, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, power)
        for batch in batches:
            # A few rows at a time: what is held grows with CHARS_AT_ONCE, not with the batch.
            sizes = pc.fill_null(pc.utf8_length(batch.column(len(kept) + 1)), 0).to_numpy(zero_copy_only=False).cumsum()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHARS_AT_ONCE, "right")))
                part, lo = batch.slice(lo, hi - lo), hi
                ids = pieces.sample([k or 0 for k in part.column(len(kept)).to_pylist()], part.column(len(kept) + 1).to_pylist(), seed)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns = [*part.columns[: len(kept)], pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))]
                if decoded:
                    columns.append(pa.array(map(pieces.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        pieces.forget()  # the worker lives on and others need the room
        give_back()

    return source.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, model: str, ids: str = "piece_ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text of every row's ids."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = pieces_of(model)
        for rows in batches:
            yield pd.Series([pieces.decode(x) if x is not None else "" for x in rows], dtype=object)

    return encoded.withColumn(into, F.pandas_udf(run, "string")(F.col(ids)))


def op6(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash, n_chars and text_crc32, the last two of the decoded text."""
    back = encode(docs.select("doc_id", "text"), model, decoded="text")  # in the text's place, so that it passes once
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        F.length("text").cast("long").alias("n_chars"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
