"""Unique elements of a stream.

An element's result depends on the static blocks alone, so the stream needs no state and no
watermark: every micro-batch is a stream-static anti-join, by the bin of an element's end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import overlaps
from ..operators.overlap import stepped
from ..schemas import ELEMENT


def stream_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(ELEMENT).parquet(folder)


def stream_unique(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """The elements of a stream that overlap no block of ``blocks`` (chr, b_start, b_end)."""
    spans, steps = stepped(blocks)
    own = elements.columns
    placed = elements.join(spans, F.col("chr") == F.col("s_chr"), "left")
    at = F.when(F.col("te_end") < F.col("lo"), F.lit(-1).cast("long")).otherwise(F.least(F.expr("(CAST(te_end AS BIGINT) - lo) div width"), F.col("last") + 1))
    meets = (F.col("chr") == F.col("b_chr")) & (F.col("e_bin") == F.col("b_bin")) & overlaps(F.col("te_start"), F.col("te_end"), F.col("b_start"), F.col("b_end"))
    return placed.withColumn("e_bin", at).join(steps, meets, "left_anti").select(*own)
