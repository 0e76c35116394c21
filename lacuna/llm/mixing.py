"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

The mix has N = 2**m slots of equal length (all words over N, between ``BLOCK`` / 2 and ``BLOCK``).  Slot k
gets the van der Corput point of k, its m bits in reverse; the points, mapped through the sources'
cumulative targets, name a source per slot, so that every stretch of the mix holds the sources in
proportion and a source's slots miss its target by less than one.  A source's documents, shuffled
by a hash, form a stream of words which is read up to three times over and cut into blocks of a
slot's length; the r-th slot of a source takes the r-th block of its stream, and blocks without a
slot are not taken.  The schedule alone decides: there is no other quota.

Positions in a stream and ranks of slots are running sums over a whole source, and one source may
hold most rows; both are made in two levels, within hash buckets (or stretches of slots) and then
over the buckets' totals, so that no task gets a whole source.  Equal rows are told apart by a
number, made in two levels as well, and spread over the buckets by it.  Numbers of buckets grow
with the square root of the rows.  Targets take windows over one row per source.

Defined cases: null sources are one source, last in order; null, empty and blank texts have size 0
and are taken for 0 words; repeated rows are separate documents; a text of any length spans as many
blocks as it needs; an empty table gives an empty one; if nothing has a word every target is 0 and
there is no slot.  A source at its cap of three times its size is read to its end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_size, release, settle, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words of a slot at most.
BLOCK = 64
#: Slot lengths are counted in this share of a word.
FRACTION = 1 << 16
#: Slots that a row of the schedule's plan unfolds into, and those of a partition.
CHUNK, SLOTS_AT_ONCE = 1 << 14, 1 << 22


def slot_bits(total: int) -> int:
    """m for a mix of ``total`` words: the fewest slots that hold ``BLOCK`` words at most."""
    return max(0, -(-total // BLOCK) - 1).bit_length()


def reversed_bits(k: Column, m: int) -> Column:
    """The van der Corput point of k in 2**m parts: the m low bits of k in reverse."""
    half = 1
    while half < m:
        half *= 2
    width, step, x = half, half // 2, k
    while step:
        # The places of every other group of ``step`` bits.
        mask = sum(((1 << step) - 1) << at for at in range(0, width, 2 * step))
        x = F.shiftrightunsigned(x, step).bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask).cast("long")), step))
        step //= 2
    return F.shiftrightunsigned(x, half - m) if m else F.lit(0).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, bits: int = 0) -> DataFrame:
    """source, none, name, s (number), docs, source_size, target, lo, hi: one row per source; points from
    lo to hi - 1 are its own.  ``sized`` has a source twice: none (it is null) and name (never null).

    Sharing by weight with excess over the cap shared out again ends at one level L: a source gets
    min(cap, L * weight).  With sources in order of cap / weight, L follows from running sums at
    the first source that stays under its cap.  Windows here run over one row per source.
    """
    sums = sized.groupBy("none", "name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.partitionBy(F.lit(0)).orderBy("none", "name")
    every = Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "s")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sums.withColumn("s", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("s") % len(weights) + 1))
        .withColumn("cap", MAX_REPEATS * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open").cast("double"))
        # The first source, in order of cap / weight, that the level leaves under its cap sets it.
        .withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.row_number().over(by_cap).alias("k"), "level"))).over(every)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
    )
    upto = by_name.rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("target").over(every)
    edge = F.when(share > 0, F.round(F.sum("target").over(upto) / share * (1 << bits))).otherwise(0).cast("long")
    source = F.when(~F.col("none"), F.col("name")).alias("source")
    return rows.withColumn("hi", edge).withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0))).select(source, "none", "name", "s", "docs", "source_size", "target", "lo", "hi")


def schedule(targets: DataFrame, bits: int) -> DataFrame:
    """slot, s, rank: the source of every slot, and how many slots of it come before.

    Sizes of what is unfolded from few rows can't be known beforehand, so joins here are merge joins."""
    stretch = max(64, 1 << ((bits + 2) // 2))
    width = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // SLOTS_AT_ONCE)
    chunks = targets.filter("hi > lo").select("s", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {CHUNK}"), F.expr(f"(hi - 1) div {CHUNK}"))).alias("chunk"))
    own = F.sequence(F.greatest("lo", F.col("chunk") * CHUNK), F.least("hi", (F.col("chunk") + 1) * CHUNK) - 1)
    points = chunks.repartition(width, "s", "chunk").select("s", F.explode(own).alias("u"))
    named = points.select("s", reversed_bits(F.col("u"), bits).alias("slot")).withColumn("stretch", F.expr(f"slot div {stretch}"))
    ranked = named.withColumn("within", F.row_number().over(Window.partitionBy("stretch", "s").orderBy("slot")) - 1)
    counts = named.groupBy("stretch", "s").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("s").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("stretch", "s", F.coalesce(earlier, F.lit(0)).alias("base"))
    return ranked.join(bases.hint("merge"), ["stretch", "s"]).select("slot", "s", (F.col("base") + F.col("within")).alias("rank"))


def number_equals(sized: DataFrame) -> DataFrame:
    """``sized`` with ``copy``: equal rows (doc_id, s, tie) numbered from 0.

    ``k`` is a row id whose high bits are a part of the table: rows are numbered within the parts,
    and the parts' counts summed up, so that no task gets all copies of a row."""
    alike = ["doc_id", "s", "tie"]
    parted = sized.withColumn("part", F.shiftright("k", 33))
    inner = F.row_number().over(Window.partitionBy(*alike, "part").orderBy("k")) - 1
    counts = parted.groupBy(*alike, "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Few rows have a copy in an earlier part; only for those there is a base to add.
    bases = counts.withColumn("base", earlier).filter("base > 0").select(*[F.col(c).alias(f"b_{c}") for c in (*alike, "part")], "base")
    same = F.col("part") == F.col("b_part")
    for c in alike:
        same &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return parted.withColumn("inner", inner).join(bases, same, "left").withColumn("copy", F.coalesce("base", F.lit(0)) + F.col("inner"))


def positions(numbered: DataFrame, n_docs: int, seed: int) -> DataFrame:
    """``numbered`` with ``at``: the words before a document in its source's shuffled stream."""
    buckets = max(64, 1 << ((n_docs.bit_length() + 1) // 2))
    mixed = numbered.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "tie", "copy")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    order = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "tie", "copy").rowsBetween(Window.unboundedPreceding, -1)
    inner = mixed.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    sums = mixed.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("s", "bucket", F.coalesce(earlier, F.lit(0)).alias("before"))
    return inner.join(bases, ["s", "bucket"]).withColumn("at", F.col("before") + F.col("inner"))


@dataclass(frozen=True)
class Places:
    """documents: k, doc_id, s, size, at, source, source_size, target; targets: one row per source;
    total: the words of all documents; bits: the logarithm of the slots."""

    documents: DataFrame
    targets: DataFrame
    total: int
    bits: int

    @property
    def length(self) -> int:
        """A slot's length in parts of a word."""
        return max(1, -(-self.total * FRACTION >> self.bits))

    def rank(self, at: str) -> Column:
        """The block that holds word ``at`` of a stream; block r begins at word r * length / FRACTION."""
        return F.expr(f"(({at} + 1) * {FRACTION} - 1) div {self.length}")

    def begin(self, rank: str) -> Column:
        return F.expr(f"{rank} * {self.length} div {FRACTION}")


def _facts(text: str = "text") -> list[Column]:
    """k (a row id), doc_id, none and name (of the source), size (words), tie (hash of the text)."""
    source = [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")]
    return [F.monotonically_increasing_id().alias("k"), F.col("doc_id"), *source, F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(text).alias("tie")]


FACTS = ["k", "doc_id", "none", "name", "size", "tie"]


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """What the mix has to know of documents (doc_id, source, text)."""
    return docs.select(*_facts(text))


def place(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> Places:
    """Set the targets of measured documents (a settled table of ``sizes``) and lay out the streams."""
    total, n = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    bits = slot_bits(total)
    targets = settle(source_targets(sized, weights, bits), "mix-targets")
    known = join_by_size(sized, targets.select("none", "name", "s", "docs", "source", "source_size", "target"), ["none", "name"], "docs", n)
    placed = positions(number_equals(known), n, seed).select("k", "doc_id", "s", "size", "at", "source", "source_size", "target")
    return Places(settle(placed, "mix-places"), targets, total, bits)


def _with_slots(blocks: DataFrame, places: Places) -> DataFrame:
    """Blocks (s, rank, ...) with the slot that the schedule has for them; those without go."""
    return blocks.join(schedule(places.targets, places.bits).hint("merge"), ["s", "rank"])


def _passes(places: Places) -> DataFrame:
    """The documents with words as often as a stream may be read, with their place ``lo`` in it.
    Those far beyond a source's target are left out: the schedule has no slot there."""
    return (
        places.documents.filter("size > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
        .withColumn("lo", F.col("pass") * F.col("source_size") + F.col("at"))
        .filter(F.col("lo") < F.col("target") + 2 * BLOCK)
    )


def mix(places: Places) -> DataFrame:
    """The mix: slot, rank, source, k, doc_id, size, lo, and the words taken there, ``first`` to
    ``last`` (from 0, last excluded).  In order of slot and lo this is the training stream."""
    hi = F.col("lo") + F.col("size")
    parts = (
        _passes(places)
        .withColumn("rank", F.explode(F.sequence(places.rank("lo"), places.rank("lo + size - 1"))))
        .withColumn("first", F.greatest("lo", places.begin("rank")) - F.col("lo"))
        .withColumn("last", F.least(hi, places.begin("(rank + 1)")) - F.col("lo"))
    )
    return _with_slots(parts, places).select("slot", "rank", "source", "k", "doc_id", "size", "lo", "first", "last")


def taken_words(places: Places) -> DataFrame:
    """``places.documents`` with ``taken`` (words), ``n_slots`` and ``first_slot`` (null: none)."""
    sums = mix(places).groupBy("k").agg(F.sum(F.col("last") - F.col("first")).alias("words"), F.count(F.lit(1)).alias("slots"), F.min("slot").alias("first_slot"))
    return places.documents.join(sums, "k", "left").withColumns({"taken": F.coalesce("words", F.lit(0)), "n_slots": F.coalesce("slots", F.lit(0))}).drop("words", "slots")


def whole_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix in whole documents, in its order: the columns of ``docs``, a row for each time that the
    block which holds a document's middle word has a slot (up to three times, or never).

    A source comes within half a document of its target.  Documents without words are not taken.
    Rows lie in order of their slots, over the partitions too.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    held = settle(docs.select(row, "doc_id", "source", "text").select("row", *_facts()), "mix-rows")
    places = place(held.select(*FACTS), weights, seed)
    middles = _passes(places).withColumn("rank", places.rank("lo + size div 2"))
    turns = _with_slots(middles, places).select("k", "slot", "lo")
    mixed = held.select("k", "row").join(turns, "k").repartitionByRange("slot", "lo").sortWithinPartitions("slot", "lo")
    return mixed.select("row.*")


def op4(docs: DataFrame) -> DataFrame:
    sized = settle(sizes(docs), "mix-sizes")
    out = taken_words(place(sized)).select("doc_id", "size", "source", "source_size", "target", "taken", "n_slots", "first_slot")
    release(sized)
    return out
