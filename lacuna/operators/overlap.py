"""Interval semi- and anti-join of elements with synteny blocks.

``unique`` keeps elements that overlap no block of their chromosome, ``in_synteny`` those that do.
There are three plans with the same result:

* ``broadcast``: a hash join on the chromosome with the range test as residue.  Work is elements
  times blocks per chromosome, so it is for few blocks; their number is checked first, and more than
  ``BROADCAST_ROWS`` are swept even if this plan is asked for.
* ``sweep``: an element overlaps a block if and only if the largest block end among blocks of its
  chromosome that start at or before the element's end reaches the element's start.  That largest
  end comes in two levels: a running maximum within a stretch of the chromosome, and the largest
  end of all earlier stretches.  Elements are read once; they and the blocks are shuffled once,
  together, by stretch, so no task holds a whole chromosome.
* ``binned``: blocks and elements are laid over bins of equal width and joined by bin.

``marked`` tells of every element whether it overlaps a block, in one pass.

Elements whose start lies after their end are tested as they stand, by all three.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import overlaps

#: Blocks on one chromosome, and in all, up to which the blocks are broadcast.
BROADCAST_PER_CHR, BROADCAST_ROWS = 1_000, 100_000
#: Stretches that the sweep cuts a chromosome into, at most as many as it has blocks.
STRETCHES = 4096
#: Stretches, on each chromosome, for elements outside the span of its blocks.
APART = 256
#: Bins that a block covers on average.
BINS_PER_BLOCK = 2
#: Blocks that start in a bin, on average, for elements that arrive in a stream.
BLOCKS_PER_BIN = 32


def side(synteny: DataFrame, genome: int) -> DataFrame:
    """(chr, b_start, b_end): the blocks on genome 1 or 2; there are none on any other."""
    g = genome if genome in (1, 2) else 1
    out = synteny.select(F.col(f"chr{g}").alias("chr"), F.col(f"start{g}").alias("b_start"), F.col(f"end{g}").alias("b_end"))
    return out if genome in (1, 2) else out.filter(F.lit(False))


@dataclass(frozen=True)
class _Blocks:
    """Blocks, a row per chromosome (chr, n, lo, hi, top: how many, first and last start, largest end),
    and from those the number of chromosomes, of all blocks, and of the most on one."""

    rows: DataFrame
    spans: DataFrame
    chromosomes: int
    n: int
    most: int

    @classmethod
    def of(cls, blocks: DataFrame) -> _Blocks:
        """One small aggregate over the block table."""
        spans = blocks.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.min("b_start").alias("lo"), F.max("b_start").alias("hi"), F.max("b_end").alias("top"))
        told = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        return cls(blocks, spans, *told)

    @property
    def few(self) -> bool:
        """Whether they may be broadcast."""
        return self.most <= BROADCAST_PER_CHR and self.n <= BROADCAST_ROWS


def _broadcast(elements: DataFrame, blocks: _Blocks, how: str) -> DataFrame:
    if blocks.n > BROADCAST_ROWS:
        return _sweep(elements, blocks, how)
    b = F.broadcast(blocks.rows.select(F.col("chr").alias("b_chr"), "b_start", "b_end"))
    return elements.join(b, (F.col("chr") == F.col("b_chr")) & overlaps(F.col("te_start"), F.col("te_end"), F.col("b_start"), F.col("b_end")), how)


def _swept(elements: DataFrame, blocks: _Blocks) -> DataFrame:
    """row (an element), hit: whether it overlaps a block."""
    # A stretch per block at most, so that there are no more stretches than blocks.
    width = F.greatest(F.lit(1), F.ceil((F.col("hi").cast("long") - F.col("lo") + 1) / F.least(F.lit(STRETCHES), F.col("n"))))
    spans = blocks.spans.select(F.col("chr").alias("s_chr"), "lo", "hi", "top", width.alias("width"))
    if blocks.chromosomes <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    stretch = F.expr("(CAST(pos AS BIGINT) - lo) div width")

    # Outside the span of starts all blocks of the chromosome count, or none: the answer is known, and
    # those elements only pass through, spread over ``APART`` stretches of their own.
    own = elements.select(F.struct(*elements.columns).alias("row"), F.col("chr").alias("chr"), F.col("te_end").alias("pos"), F.col("te_start").alias("start"))
    inside = F.coalesce(F.col("pos").between(F.col("lo"), F.col("hi")), F.lit(False))
    known = F.when(~inside, F.coalesce((F.col("pos") > F.col("hi")) & (F.col("top") >= F.col("start")), F.lit(False)))
    apart = -1 - F.pmod(F.xxhash64("pos", "start"), F.lit(APART))
    placed = own.join(spans, F.col("chr") == F.col("s_chr"), "left").select("chr", F.when(inside, stretch).otherwise(apart).alias("stretch"), "pos", F.lit(1).alias("k"), F.lit(None).cast("int").alias("b_end"), "start", "row", known.alias("known"))

    starts = blocks.rows.select("chr", F.col("b_start").alias("pos"), "b_end").join(spans, F.col("chr") == F.col("s_chr")).withColumn("stretch", stretch)
    events = placed.unionByName(starts.select("chr", "stretch", "pos", F.lit(0).alias("k"), "b_end"), allowMissingColumns=True)
    order = Window.partitionBy("chr", "stretch").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, 0)
    inner = events.withColumn("inner", F.max("b_end").over(order)).filter("k = 1")

    # The largest end of all earlier stretches, for every stretch from the second on: one row for
    # each stretch with blocks, unfolded up to the next of them.
    tops = starts.groupBy("chr", "stretch").agg(F.max("b_end").alias("top"), F.max(F.expr("(CAST(hi AS BIGINT) - lo) div width")).alias("last"))
    along = Window.partitionBy("chr").orderBy("stretch")
    steps = tops.select("chr", "stretch", F.max("top").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("carry"), F.coalesce(F.lead("stretch").over(along), F.col("last")).alias("upto"))
    carried = steps.filter("upto > stretch").select(F.col("chr").alias("c_chr"), F.explode(F.sequence(F.col("stretch") + 1, F.col("upto"))).alias("c_stretch"), "carry")
    if min(blocks.n, blocks.chromosomes * STRETCHES) <= BROADCAST_ROWS:  # stretches in all, by the rule above
        carried = F.broadcast(carried)
    joined = inner.join(carried, (F.col("chr") == F.col("c_chr")) & (F.col("stretch") == F.col("c_stretch")), "left")
    return joined.select("row", F.coalesce("known", F.greatest("inner", "carry") >= F.col("start"), F.lit(False)).alias("hit"))


def _sweep(elements: DataFrame, blocks: _Blocks, how: str) -> DataFrame:
    swept = _swept(elements, blocks)
    return swept.filter("hit" if how == "left_semi" else "not hit").select("row.*")


def _binned(elements: DataFrame, blocks: _Blocks, how: str) -> DataFrame:
    blocks = blocks.rows
    mean = blocks.agg(F.avg(F.col("b_end").cast("long") - F.col("b_start") + 1)).first()[0]
    width = max(1, int((mean or 1) // BINS_PER_BLOCK))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    b = blocks.filter("b_start <= b_end").select(F.col("chr").alias("b_chr"), "b_start", "b_end", bins(F.col("b_start"), F.col("b_end")).alias("b_bin"))
    e = elements.select("chr", "te_start", "te_end").distinct()
    e = e.withColumn("bin", bins(F.least("te_start", "te_end"), F.greatest("te_start", "te_end")))
    hit = e.join(b, (F.col("chr") == F.col("b_chr")) & (F.col("bin") == F.col("b_bin")) & overlaps(F.col("te_start"), F.col("te_end"), F.col("b_start"), F.col("b_end")), "left_semi")
    hit = hit.select(F.col("chr").alias("h_chr"), F.col("te_start").alias("h_start"), F.col("te_end").alias("h_end")).distinct()
    return elements.join(hit, (F.col("chr") == F.col("h_chr")) & (F.col("te_start") == F.col("h_start")) & (F.col("te_end") == F.col("h_end")), how)


def stepped(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks laid out so that an element meets them by equality, once: spans (s_chr, lo, width, last)
    and steps (b_chr, b_bin, b_start, b_end).

    An element belongs to the bin of its end, at most ``last`` + 1.  A bin has the blocks that start
    in it, one per start and so no more than it is wide, about ``BLOCKS_PER_BIN`` on average, and one
    row for all earlier blocks, with their largest end."""
    starts = blocks.groupBy("chr", "b_start").agg(F.max("b_end").alias("b_end"))
    spans = starts.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.min("b_start").alias("lo"), F.max("b_start").alias("hi"))
    width = F.ceil((F.col("hi").cast("long") - F.col("lo") + 1) / F.ceil(F.col("n") / BLOCKS_PER_BIN))
    spans = spans.select(F.col("chr").alias("s_chr"), "lo", "hi", width.alias("width")).withColumn("last", F.expr("(CAST(hi AS BIGINT) - lo) div width")).drop("hi")
    placed = starts.join(spans, F.col("chr") == F.col("s_chr")).select("chr", F.expr("(CAST(b_start AS BIGINT) - lo) div width").alias("bin"), "b_start", "b_end", "last")
    tops = placed.groupBy("chr", "bin").agg(F.max("b_end").alias("top"), F.max("last").alias("last"))
    along = Window.partitionBy("chr").orderBy("bin")
    earlier = tops.select("chr", "bin", F.max("top").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("b_end"), F.coalesce(F.lead("bin").over(along), F.col("last") + 1).alias("upto"))
    carried = earlier.select("chr", F.explode(F.sequence(F.col("bin") + 1, F.col("upto"))).alias("bin"), F.lit(-(2**63)).cast("long").alias("b_start"), "b_end")
    steps = placed.select("chr", "bin", "b_start", "b_end").unionByName(carried)
    return spans, steps.withColumnsRenamed({"chr": "b_chr", "bin": "b_bin"})


PLANS = {"broadcast": _broadcast, "sweep": _sweep, "binned": _binned}


def _join(elements: DataFrame, blocks: DataFrame, how: str, strategy: str) -> DataFrame:
    known = _Blocks.of(blocks)
    if strategy == "auto":
        strategy = "broadcast" if known.few else "sweep"
    return PLANS[strategy](elements, known, how)


def marked(elements: DataFrame, blocks: DataFrame, into: str = "hit") -> DataFrame:
    """``elements`` with a boolean column: whether an element overlaps a block.  One pass over each."""
    return _swept(elements, _Blocks.of(blocks)).select("row.*", F.col("hit").alias(into))


def unique(elements: DataFrame, blocks: DataFrame, strategy: str = "auto") -> DataFrame:
    """The elements (chr, te_start, te_end, ...) that overlap no block; repeated rows are kept."""
    return _join(elements, blocks, "left_anti", strategy)


def in_synteny(elements: DataFrame, blocks: DataFrame, strategy: str = "auto") -> DataFrame:
    """The elements that overlap a block, each once per row."""
    return _join(elements, blocks, "left_semi", strategy)
