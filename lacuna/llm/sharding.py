"""Shards by a keyed permutation of global row numbers.

Every document gets a global row number; a Feistel network with cycle walking permutes 0 to n - 1;
the image p gives the shard p mod S and the slot p div S.  Anyone who has the row number, n and
the key can compute both, and nothing has to be sorted into a random order.

Row numbers run through hash buckets, and by doc_id within a bucket: buckets are numbered in parallel
and one small running sum joins them, so no task sorts more than a bucket.  Rows that are equal in
all that counts (doc_id, size, checksum, hash of the text) are interchangeable: they are merged first, numbered
as a group, ``COPIES`` at a time, each such part in a bucket of its own, and unfolded afterwards, so a
row that is repeated any number of times burdens no task.  The number of buckets grows with the
square root of the rows.

The law that holds is ``rows``: shards differ by one row at most, slots have no gaps.

Defined cases: a null text counts no bytes (size 1) and has the crc32 of the empty text; repeated
doc_ids, and whole repeated rows, are separate rows with places of their own; a null doc_id is a
value like others; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
ROUNDS = 6
#: Equal rows that are numbered together.
COPIES = 1 << 16
KEY = 0x5EED


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit sways every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(key: int) -> list[np.uint64]:
    return [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64) for r in range(ROUNDS)]


def _half_bits(n: int) -> np.uint64:
    return np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))


def permute(rows: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The images of row numbers below ``n``.  The network works on the next even number of bits
    and images outside 0 to n - 1 walk on along their cycle, which leads back inside."""
    half = _half_bits(n)
    mask, keys = np.uint64((1 << int(half)) - 1), _keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << half) | right

    out = once(rows.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def invert(images: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The row numbers of images: which row is in a given shard and slot."""
    half = _half_bits(n)
    mask, keys = np.uint64((1 << int(half)) - 1), _keys(key)[::-1]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right ^ (_mix(left ^ k) & mask), left
        return (left << half) | right

    out = once(images.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def number_rows(facts: DataFrame, n: int, into: str = "row") -> DataFrame:
    """The ``n`` rows of ``facts`` with consecutive numbers from 0 in column ``into``, the same in every
    run.  Rows that are equal in all columns get neighbouring numbers, ``COPIES`` at a time."""
    own = facts.columns
    buckets = max(64, 1 << ((n.bit_length() + 5) // 2))
    groups = facts.groupBy(*own).agg(F.count(F.lit(1)).alias("_copies"))
    parts = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES}"))))
    held = parts.withColumn("_held", F.least(F.lit(COPIES), F.col("_copies") - F.col("_part") * COPIES)).withColumn("_bucket", F.pmod(F.xxhash64(*own, "_part"), F.lit(buckets)))
    within = Window.partitionBy("_bucket").orderBy(*own, "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = held.groupBy("_bucket").agg(F.sum("_held").alias("_n")).select("_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    first = held.withColumn("_inner", F.coalesce(F.sum("_held").over(within), F.lit(0))).join(bases, "_bucket").withColumn("_first", F.col("_base") + F.col("_inner"))
    return first.select(*own, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_held") - 1)).alias(into))


def assign(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot for documents (doc_id, text)."""
    plain = F.coalesce("text", F.lit(""))
    n = docs.count()
    facts = docs.select("doc_id", (F.octet_length(plain) + 1).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("tie"))

    @F.pandas_udf("long")
    def image(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(np.int64), n, key))

    placed = number_rows(facts, n).withColumn("p", image("row"))
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("p") % shards).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"))


def op10(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
