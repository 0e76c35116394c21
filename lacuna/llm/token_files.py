"""Token ids of a corpus in patched frame-of-reference files.

File format, all integers little-endian.  A file holds the ids of a run of documents in ascending
doc_id order, one after the other, cut into blocks of ``BLOCK_IDS`` ids:

    magic  b"PFR1"
    block  uint32 minimum, uint8 width, uint8 zero, uint16 number of ids less one,
           uint16 number of exceptions, then the ids less the minimum, ``width`` low bits each,
           packed from the lowest bit, then the exceptions: uint16 positions, uint32 high parts
    index  per block: uint64 file offset of its start
           per document: int64 doc_id (null: the smallest int64), int64 number of ids
    tail   uint64 offset of the index, uint32 blocks, uint64 documents, uint64 ids, magic

``width`` is the number of bits that the 90th percentile of a block's differences needs; larger
differences leave their high parts in the exception list.  Any block can be read by itself.

Documents are dealt out by ranges of doc_id and every task writes one file, under a temporary name
that is moved into place when it is whole, so a task that is run again leaves the same file.  Ids
before a document in earlier files come from the files' totals; nothing of the documents goes to
the driver.

Defined cases: a null text encodes as the empty text and so does an empty one (the end id alone);
repeated doc_ids keep one entry each, ordered by a hash of their texts, then the texts; a null doc_id
comes first.  Texts of any length are encoded whole.  The folder is written and read through pyarrow's
file systems (local ones, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder

MAGIC = b"PFR1"
BLOCK_IDS = 4096
PERCENTILE = 90
END_ID = 2
NO_ID = -(2**63)
#: Distinct words whose ids a worker remembers.
WORDS_KEPT = 650_000
#: Texts on which a tokenizer is tried out.
PROBES = 300
#: Characters encoded together, and rows handed to a worker together.
CHARS_AT_ONCE, ROWS_AT_ONCE = 3_000_000, 2000
_BLOCK, _TAIL = struct.Struct("<IBBHH"), struct.Struct("<QIQQ4s")


def pack(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bits of each value, one after the other."""
    if not width:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray) -> bytes:
    """One block of 1 to 65,536 ids below 2**32."""
    least = int(ids.min())
    rest = (ids - np.uint32(least)).astype(np.uint32)
    width = int(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    odd = np.flatnonzero(high)
    if len(odd) > 65_535:
        width, odd = 32, odd[:0]
    return _BLOCK.pack(least, width, 0, len(ids) - 1, len(odd)) + pack(rest, width) + odd.astype("<u2").tobytes() + high[odd].astype("<u4").tobytes()


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    least, width, _, last, odd = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    size = ((last + 1) * width + 7) // 8
    out = unpack(data[at : at + size], last + 1, width)
    if odd:
        where = np.frombuffer(data, "<u2", odd, at + size)
        out[where] |= np.frombuffer(data, "<u4", odd, at + size + 2 * odd) << np.uint32(width)
    return out + np.uint32(least)


def write_ids(out, documents: Iterable[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Write documents' ids to a file object; the numbers of documents and of ids."""
    at = out.write(MAGIC)
    starts: list[int] = []
    keys: list[tuple[int, int]] = []
    held: list[np.ndarray] = []
    n = total = 0

    def flush(last: bool) -> None:
        nonlocal at, n, held
        ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for k in range(0, whole, BLOCK_IDS):
            starts.append(at)
            at += out.write(encode_block(ids[k : k + BLOCK_IDS]))
        held, n = [ids[whole:]] if whole < len(ids) else [], len(ids) - whole

    for key, ids in documents:
        keys.append((NO_ID if key is None else key, len(ids)))
        held.append(ids)
        n += len(ids)
        total += len(ids)
        if n >= 64 * BLOCK_IDS:
            flush(False)
    flush(True)
    out.write(np.array(starts, "<u8").tobytes())
    out.write(np.array(keys, "<i8").tobytes())
    out.write(_TAIL.pack(at, len(starts), len(keys), total, MAGIC))
    return len(keys), total


def read_ids(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file (an object with seek and read), holding a few blocks at a time."""
    size = source.seek(0, 2)
    source.seek(size - _TAIL.size)
    index, n_blocks, n_docs, _, magic = _TAIL.unpack(source.read(_TAIL.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    source.seek(index)
    starts = np.frombuffer(source.read(8 * n_blocks), "<u8").tolist() + [index]
    keys = np.frombuffer(source.read(16 * n_docs), "<i8").reshape(-1, 2)
    held, k = np.zeros(0, np.uint32), 0
    for key, n in keys.tolist():
        parts, got = [held], len(held)
        while got < n:
            upto = min(n_blocks, k + 64)
            source.seek(starts[k])
            data = source.read(starts[upto] - starts[k])
            for j in range(k, upto):
                parts.append(decode_block(data, starts[j] - starts[k]))
                got += len(parts[-1])
            k = upto
        ids = np.concatenate(parts) if len(parts) > 1 else held
        held = ids[n:]
        yield None if key == NO_ID else key, ids[:n]


class Encoder:
    """Ids of whole texts.

    Where the tokenizer's normalizer and pre-tokenizer never look across a space or line feed, a text's
    ids are those of its words between them, in order.  A distinct word then goes through the
    tokenizers library once and is remembered, until ``WORDS_KEPT`` are; new words are encoded many at
    a time, with a special token between them, which the library cuts out before anything else.
    That is tried out on ``PROBES`` texts made of the vocabulary; a tokenizer that fails there, such
    as one with spaces inside its tokens, gets whole texts instead.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.single_word and not t.lstrip and not t.rstrip}
        self.cut = max(special.items(), default=None)
        self.by_word = True
        probes = self._probes()
        self.by_word = all((a[:-1] == b).all() if len(a) == len(b) + 1 else False for a, b in zip(self(probes), self._encode(probes)))
        self.known.clear()

    def _probes(self) -> list[str]:
        """Texts of the vocabulary's tokens, alone, joined by spaces and line feeds of any number."""
        tokens = sorted(self.tokenizer.get_vocab())
        step = max(1, len(tokens) // (4 * PROBES))
        plain = [self.tokenizer.decode([self.tokenizer.token_to_id(t)], skip_special_tokens=False) or t for t in tokens[::step]]
        gaps = (" ", "\n", "  ", " \n", "\n ", "\n\n ")
        return [gaps[k % 6].join(plain[k::PROBES]) for k in range(PROBES)] + [f"{g}{plain[0]}{g}" for g in gaps]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        known = self.known
        apart = [w for w in new if self.cut is None or not w or self.cut[1] in w]
        known.update(zip(apart, (ids.tobytes() for ids in self._encode(apart))))
        joined = [w for w in new if w not in known] if apart else new
        groups = [joined[k : k + 64] for k in range(0, len(joined), 64)]
        for lo in range(0, len(groups), 128):
            part = groups[lo : lo + 128]
            for group, ids in zip(part, self._encode([self.cut[1].join(g) for g in part])):
                data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.cut[0])).tolist()
                ends.append(len(data))
                at = 0
                for word, stop in zip(group, ends, strict=True):
                    known[word] = data[at:stop]
                    at = stop + 4

    def __call__(self, texts: list[str], end: int = END_ID) -> list[np.ndarray]:
        tail = np.array([end], np.uint32)
        if not self.by_word:
            return [np.concatenate([ids, tail]) for ids in self._encode(texts)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known))
        full = len(known) >= WORDS_KEPT
        self._learn(new)
        ids, last = known.__getitem__, tail.tobytes()
        out = [np.frombuffer(b"".join(map(ids, ws)) + last, np.uint32) for ws in split]
        if full:  # the words known by then, frequent ones among them, stay
            for w in new:
                del known[w]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer: a worker keeps it from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open_folder(folder: str):
    """The folder's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_files(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files of ``folder``; run the result to write them.

    One row per file: part, path, n_docs, n_tokens.
    """
    text = F.coalesce("text", F.lit(""))
    ranged = (
        docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open_folder(folder)
        context = TaskContext.get()
        part, encode = context.partitionId(), encoder(tokenizer)

        def documents():
            for pdf in batches:
                keys = [None if pd.isna(k) else int(k) for k in pdf["doc_id"]]
                texts, lo, n = pdf["text"].tolist(), 0, 0
                for hi, text in enumerate(texts, 1):
                    n += len(text)
                    if n > CHARS_AT_ONCE or hi == len(texts):
                        yield from zip(keys[lo:hi], encode(texts[lo:hi]))
                        lo, n = hi, 0

        path = f"{base}/part-{part:06d}.pfr"
        draft = f"{path}.{context.taskAttemptId()}"
        system.create_dir(base, recursive=True)
        with system.open_output_stream(draft) as out:
            n_docs, n_tokens = write_ids(out, documents())
        system.move(draft, path)
        yield pd.DataFrame({"part": [part], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return ranged.mapInPandas(write, "part int, path string, n_docs long, n_tokens long")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Documents of written files (part, path, n_tokens): doc_id, start, n_tokens, ids_crc32."""
    # One row per file: a window over so few rows needs no parallelism.
    before = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    dealt = files.withColumn("base", F.coalesce(before, F.lit(0))).select("part", "path", "base")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _open_folder(folder)
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"]):
                with system.open_input_file(path) as source:
                    at, rows = int(base), []
                    for key, ids in read_ids(source):
                        rows.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    n = max(1, dealt.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(n, "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64"})


def encode_corpus(spark: SparkSession, docs: DataFrame, tokenizer: str) -> tuple[DataFrame, str]:
    """Write the token files of a corpus; the table of files and their folder."""
    folder = new_folder(spark, "tokens")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(rows)
    spark.conf.set(rows, str(min(ROWS_AT_ONCE, int(was)) if int(was) > 0 else ROWS_AT_ONCE))
    try:
        write_files(docs, tokenizer, f"{folder}/files").write.parquet(f"{folder}/index")
    finally:
        spark.conf.set(rows, was)
    return spark.read.parquet(f"{folder}/index"), f"{folder}/files"


def op2(docs: DataFrame, tokenizer: str) -> DataFrame:
    files, folder = encode_corpus(docs.sparkSession, docs, tokenizer)
    return read_files(files, folder)
