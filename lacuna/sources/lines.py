"""Lines of text files with their true numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): every line of a file, numbered from 1 within its file.

    A large file is read in splits, each by one task from front to back, so row ids rise by one from
    line to line of a split.  Counting the splits' lines gives, with a running sum over one row per
    split, the lines before each; these rows are joined back and the text itself is not shuffled.
    Lines end at a line feed alone.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    before = F.sum("n").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    splits = raw.groupBy(F.col("path").alias("p"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    bases = splits.select("p", "b", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return raw.join(bases, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b"))).select((F.col("at") + F.col("shift")).alias("line_no"), "value")
