"""Piece sampling: exact probabilities, reproducible draws, lossless decoding."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import pieces
from lacuna.llm.entry import tokenizer_path
from lacuna.llm.pieces import SPACE, VECTOR_CHARS, Pieces, decode, encode, op6

PATH = tokenizer_path("piece_bpe_32k.model")
P = Pieces(PATH)
TEXTS = [None, "", " ", "a  b\n\tc ▁ x", " lead", "日本語 😀 é̸", "x" * 5000, "\n\n", "\x00 a\x7f", "▁▁a ▁", "the quick brown fox", "ab" * (VECTOR_CHARS // 2 + 3)]


def test_lossless():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text, ids in zip(TEXTS, P.sample(list(range(len(TEXTS))), TEXTS)):
        assert P.decode(ids) == (text or "")
        if "\x00" not in (text or ""):
            assert library.decode(ids.tolist()) == (text or "")


@given(st.lists(st.text(max_size=60), min_size=1, max_size=5), st.integers(-(2**63), 2**63 - 1))
@settings(max_examples=60, deadline=None)
def test_lossless_on_any_text(texts, key):
    ids = P.sample([key] * len(texts), texts)
    assert [P.decode(i) for i in ids] == texts


def segmentations(s):
    if not s:
        return [((), 1.0)]
    out = []
    for n in range(1, len(s) + 1):
        v = P.table.get(s[:n], -1)
        if v >= 0:
            out += [((v, *rest), P.weight[v] * w) for rest, w in segmentations(s[n:])]
    return out


@pytest.mark.parametrize("word", ["fox", "thing"])
def test_probabilities(word):
    """Draws over many keys against all segmentations."""
    every = segmentations(SPACE + word)
    total, n = sum(w for _, w in every), 20_000
    seen = Counter(tuple(i.tolist()) for i in P.sample(list(range(n)), [word] * n))
    assert set(seen) <= {s for s, _ in every}
    for s, w in every:
        p = w / total
        assert abs(seen[s] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1


def test_long_and_short_chunks_agree():
    """Both ways of building a lattice give the same one."""
    for chunk in (" nothing", "é日x", "  two", "\n"):
        a, b = P._many([chunk]), P._long(chunk)
        for x, y in zip(a[:5], b[:5]):
            assert np.allclose(x, y, atol=1e-9)


def long_chunks():
    r = np.random.default_rng(3)
    ascii64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return {
        "base64": "".join(ascii64[k] for k in r.integers(0, 64, 300_000)),
        "chinese": "".join(chr(k) for k in r.integers(0x4E00, 0x9FA5, 300_000)),
        "one letter": "a" * 300_000,
        "words": "".join(r.choice(["the", "ing", "\u00e9t\u00e9", "\U0001f600", "of", "\x00"], 100_000)),
    }


@pytest.mark.parametrize("kind", ["base64", "chinese", "one letter", "words"])
def test_long_chunks(monkeypatch, kind):
    """Cut where no piece crosses, or filtered in stripes, a long chunk has the same lattice, in little time."""
    import time

    text = long_chunks()[kind]
    fresh = Pieces(PATH)
    began = time.process_time()
    (ids,) = fresh.sample([5], [text])
    assert time.process_time() - began < 12 and fresh.decode(ids) == text
    head = text[:3000]
    assert "".join(P.parts(f" {head}")) == f" {head}"
    (cut,) = Pieces(PATH).sample([5], [head])
    monkeypatch.setattr(pieces, "STRIPE", 100)
    (striped,) = Pieces(PATH).sample([5], [head])
    monkeypatch.setattr(Pieces, "parts", lambda self, chunk: [chunk])
    (whole,) = Pieces(PATH).sample([5], [head])
    # Probabilities agree but for the last digits, so hardly a draw differs.
    for other in (striped, whole):
        assert len(cut) == len(other) and (cut != other).sum() <= 4


def test_reproducible():
    texts = [f"some words of text number {i}" for i in range(300)]
    whole = P.sample(list(range(300)), texts)
    fresh = Pieces(PATH)
    alone = [fresh.sample([i], [t])[0] for i, t in list(enumerate(texts))[::-37]]
    assert all((a == b).all() for a, b in zip(alone, whole[::-37]))
    assert any((a != b).any() if len(a) == len(b) else True for a, b in [(P.sample([k], [texts[0]])[0], whole[0]) for k in range(1, 60)])


def test_query(spark):
    rows = [(i % 5, t) for i, t in enumerate(TEXTS)] + [(None, "x y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece_ids", "2 AS n_pieces").repartition(3)
    import zlib

    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.text_crc32) for r in op6(docs, PATH).collect())
    assert got == sorted((-1 if k is None else k, len(t or ""), zlib.crc32((t or "").encode())) for k, t in rows)
    assert op6(docs.limit(0), PATH).count() == 0
    back = decode(encode(docs.select("doc_id", "text"), PATH), PATH, into="again")
    assert back.filter("coalesce(text, '') <> again").count() == 0


def test_workers_keep_no_lattices(spark):
    """What a task learned is forgotten at its end; only the vocabulary stays in the worker."""

    def held(batches):
        for batch in batches:
            yield batch.assign(id=sum(len(p.ends) + len(p.upto) for p in pieces._PIECES.values()))

    docs = spark.createDataFrame([(i, f"word{i} and some more of them") for i in range(400)], "doc_id long, text string").repartition(8)
    op6(docs, PATH).collect()
    assert {r.id for r in spark.range(0, 64, 1, 8).mapInPandas(held, "id long").collect()} == {0}


def test_the_text_passes_once(spark, monkeypatch):
    """A worker gets the text in one column, not in two."""
    docs = spark.createDataFrame([(1, "s", "x y")], "doc_id long, source string, text string")
    seen, frame = [], type(docs)
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: seen.append([t for _, t in self.dtypes]) or whole(self, *a, **k))
    assert op6(docs, PATH).first().n_chars == 3
    assert seen == [["bigint", "bigint", "string"]]


def test_a_word_ends_a_chunk():
    """Whatever no piece joins to a word's last letter parts chunks, so that few are distinct."""
    assert P.chunks(" word. word, word$x word% (word) d'or²a word\nword") == [" word", ".", " word", ",", " word", "$x", " word", "%", " (word)", " d", "'or²a", " word", "\n", "word"]


@given(st.lists(st.sampled_from(["w", "é", "²", ".", "$", "9", " ", "\n", "_", "ing", "日", "▁", "'", ","]), max_size=30).map("".join))
@settings(max_examples=200, deadline=None)
def test_no_piece_crosses_a_cut(text):
    parts = P.chunks(f" {text}")
    assert "".join(parts) == f" {text}"
    whole, cuts = f" {text}".replace(SPACE, "\0").replace(" ", SPACE), np.cumsum([len(c) for c in parts])[:-1].tolist()
    for cut in cuts:
        for lo in range(max(0, cut - P.longest), cut):
            for hi in range(cut + 1, min(len(whole), lo + P.longest) + 1):
                assert P.table.get(whole[lo:hi], -1) < 0


def test_lattices_stay_in_place(monkeypatch):
    """A full memory is not copied for a batch's own chunks, which leave no trace in it."""
    monkeypatch.setattr(pieces, "CHUNKS_KEPT", 1000)
    p = Pieces(PATH)
    p.sample([0], [" ".join(f"kept{k}\x01" for k in range(2000))])
    p.sample([1], [" ".join(f"make{k}room{k}é\x02" for k in range(2000))])
    held, kept, ends = p.upto, p.upto[: p.n_edges].copy(), dict(p.ends)
    for k in range(3):
        text = " ".join(f"more{k}{j}é\x02" for j in range(500))
        (ids,) = p.sample([2], [text])
        assert p.decode(ids) == text
    assert p.upto is held and (p.upto[: p.n_edges] == kept).all() and p.ends == ends and max(p.extra, default=-1) < p.n_edges


def test_lattices_do_not_depend_on_the_batch():
    """Bit for bit the same, built alone or together with others."""
    chunks = [" nothing", "é日x", "  two", "\n", " a" + "b" * 30, "."]
    together = P._many(chunks)
    at = 0
    for c in chunks:
        alone = P._many([c])
        n = len(alone[1])
        assert all((a == b[at : at + n]).all() for a, b in zip(alone[1:5], together[1:5]))
        at += n
