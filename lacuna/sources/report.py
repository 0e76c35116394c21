"""Sinks: the tab-separated reports and the console text."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("id", "chr", "te_start", "te_end", "strand", "type", "family", "name")
# The report's header lines.
HEADER = "# Unique transposons in Genome {genome}\n# ID\tChr\tStart\tEnd\tStrand\tType\tFamily\tName\n"


def report_rows(elements: DataFrame, *order: str) -> DataFrame:
    """(*order, row): the report's lines; missing values are N/A, a missing strand is a point.

    Nulls are filled before joining, as joining would skip them and shift the columns."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("." if c == "strand" else "N/A")) for c in COLUMNS]
    return elements.select(*order, F.concat_ws("\t", *shown).alias("row"))


def numbered(rows: DataFrame, order: str = "line_no", width: int = 1 << 16) -> DataFrame:
    """``rows`` with their place n, from 1, in ascending ``order`` (a whole number, no two alike).

    Places run within stretches of ``width`` numbers, and over the stretches' counts."""
    held = rows.withColumn("stretch", F.floor(F.col(order) / width))
    inner = F.row_number().over(Window.partitionBy("stretch").orderBy(order))
    before = F.sum("held").over(Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    bases = held.groupBy("stretch").agg(F.count(F.lit(1)).alias("held")).select("stretch", F.coalesce(before, F.lit(0)).alias("base"))
    return held.withColumn("inner", inner).join(bases, "stretch").withColumn("n", F.col("base") + F.col("inner")).select("n", *rows.columns)


def summary_lines(s) -> list[str]:
    """The console's lines on a summary row."""
    # Console text.
    return [
        f"Genome 1: {s['te1']} transposons",
        f"Genome 2: {s['te2']} transposons",
        f"Synteny blocks: {s['synteny']}",
        "",
        "=== TE Difference Analysis Results ===",
        f"Genome 1 unique transposons: {s['unique1']} ({one_decimal(s['pct1'])}% of total)",
        f"Genome 2 unique transposons: {s['unique2']} ({one_decimal(s['pct2'])}% of total)",
    ]


def write_report(elements: DataFrame, prefix: str, genome: int) -> str:
    """Write one local file, rows in input order, partition by partition; its path.

    An unwritable path raises OSError."""
    path = f"{prefix}_genome{genome}_unique.txt"
    rows = report_rows(elements, "line_no").orderBy("line_no").select("row")
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        out.write(HEADER.format(genome=genome))
        for r in rows.toLocalIterator(prefetchPartitions=True):
            out.write(r["row"] + "\n")
    return os.path.abspath(path) if os.path.isabs(prefix) else path


def write_report_folder(elements: DataFrame, folder: str) -> None:
    """Write the rows as a folder of text files, in input order: the sink for large results."""
    report_rows(elements, "line_no").orderBy("line_no").select("row").write.mode("overwrite").text(folder)


def one_decimal(x: float) -> str:
    """A double's exact value, rounded to one decimal; formatted here as no Spark function does."""
    return "%.1f" % x


def counts_text(title: str, rows: Iterable[tuple[int, str, Iterable[tuple[str, int]]]]) -> str:
    """A section of counts per genome; genomes without any are left out."""
    out = [f"\n=== {title} ==="]
    for genome, what, counts in rows:
        counts = list(counts)
        if counts:
            out.append(f"Genome {genome} unique TE {what}:")
            out += [f"  {k}: {n}" for k, n in counts]
    return "\n".join(out)
