"""Token files: exact round trips, and the query against plain encoding."""

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm.entry import tokenizer_path
from lacuna.llm.token_files import BLOCK_IDS, Encoder, decode_block, encode_block, op2, read_ids, write_ids

PATH = tokenizer_path("word_bpe_49k.json")
ENCODE = Encoder(PATH)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), min_size=1, max_size=300))
@settings(max_examples=80, deadline=None)
def test_block_round_trip(ids):
    data = encode_block(np.array(ids, np.uint32))
    assert decode_block(b"xx" + data, 2).tolist() == ids


def test_outliers_are_exceptions():
    ids = np.full(4000, 7, np.uint32)
    ids[::100] = 4_000_000_000
    data = encode_block(ids)
    assert (decode_block(data) == ids).all() and len(data) < 400


@pytest.mark.parametrize("sizes", [[], [0], [1], [BLOCK_IDS], [BLOCK_IDS * 70, 0, 3, BLOCK_IDS - 3, 5], [2] * 9000])
def test_file_round_trip(sizes):
    r = np.random.default_rng(1)
    docs = [(k if k else None, r.integers(0, 49_000, n).astype(np.uint32)) for k, n in enumerate(sizes)]
    f = io.BytesIO()
    assert write_ids(f, docs) == (len(sizes), sum(sizes))
    back = list(read_ids(f))
    assert [k for k, _ in back] == [k for k, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(docs, back))


TEXTS = ["", " ", "a  b\n\nc", "é A̸= ≠ x", "İstanbul ΣΑΣ don't I'LL <|endoftext|>x <|startoftext|>", "　a b\tc\r\n 中文字 😀", "'s 't", "x" * 3000, "the the the", "Word, word. WORD,. It's. x.,y É, é. , . ., don'T, <|endoftext|>, a<|endoftext|>b.", "a\x1cb \x1f c\x85d\xa0e\u2028f\u2000g", "\x0b\x0c"]


@pytest.mark.parametrize("kept", [10**6, 2])
def test_encoder_equals_the_library(monkeypatch, kept):
    from lacuna.llm import token_files

    monkeypatch.setattr(token_files, "WORDS_KEPT", kept)
    encode = Encoder(PATH)
    for _ in range(3):
        for text, ids in zip(TEXTS, encode(TEXTS)):
            assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids + [2]


@given(st.lists(st.text(max_size=40) | st.text("ab ' \n\t<|>.,\u0301\u0338\u1100\u1161e", max_size=60), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_random_texts_equal_the_library(texts):
    for text, ids in zip(texts, ENCODE(texts)):
        assert ids.tolist() == ENCODE.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_a_tokenizer_that_looks_across_spaces_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models

    path = str(tmp_path / "t.json")
    Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "a ": 3, "a b": 4, "\n": 5}, [("a", " "), ("a ", "b")])).save(path)
    encode = Encoder(path)
    assert not encode.by_word and ENCODE.by_word
    assert [x.tolist() for x in encode(["a b a", "", "a\nb"])] == [[4, 2, 0, 2], [2], [0, 5, 1, 2]]


def test_query(spark):
    rows = [(k * 7 % 50, TEXTS[k % len(TEXTS)] + f" {k}") for k in range(50)] + [(5, None), (5, ""), (None, "x"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS start", "8 AS n_tokens").repartition(7)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in op2(docs, PATH).collect())
    assert [g[1] for g in got] == sorted(-1 if k is None else k for k, _ in rows)
    at = 0
    plain = [ENCODE.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    want = sorted((-1 if k is None else k, zlib.crc32(np.array(ids, "<u4").tobytes())) for (k, _), ids in zip(rows, plain))
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert sorted((k, c) for _, k, _, c in got) == want
    assert op2(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
