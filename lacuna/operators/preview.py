"""First rows of a relation, in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENT_ROWS, SYNTENY_ROWS = 10, 5


def preview(relation: DataFrame, rows: int, order: str = "line_no") -> DataFrame:
    """The first ``rows`` rows by ``order``: each task keeps its own first ones."""
    return relation.orderBy(order).limit(rows)


def element_preview(elements: DataFrame, order: str = "line_no") -> DataFrame:
    shown = [F.coalesce(F.col(c), F.lit("." if c == "strand" else "N/A")).alias(c) if c not in ("te_start", "te_end") else F.col(c) for c in ("id", "chr", "te_start", "te_end", "strand", "type", "family")]
    return preview(elements, ELEMENT_ROWS, order).select(*shown)


def synteny_preview(blocks: DataFrame, order: str = "line_no") -> DataFrame:
    return preview(blocks, SYNTENY_ROWS, order).select("chr1", "start1", "end1", "chr2", "start2", "end2", "score")
