"""Counts and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(elements: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(key, n), nulls as "unknown"; with ``order`` also ``first_seen``, the least value of that
    column in a group: groups in its order stand as they first appeared."""
    extra = [F.min(order).alias("first_seen")] if order else []
    return elements.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.count(F.lit(1)).alias("n"), *extra)


def percentage(part: Column, whole: Column) -> Column:
    """``part`` as a percentage, 0 of nothing."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")


def relation_counts(**relations: DataFrame) -> DataFrame:
    """(relation, n): a row per relation."""
    parts = [_count(df, name) for name, df in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(te1: DataFrame, te2: DataFrame, synteny: DataFrame) -> DataFrame:
    """One row: the sizes of the inputs, the unique elements, their percentages and total.

    The elements come marked (``hit``: whether they overlap a block), so each genome is read once."""
    parts = [te.agg(F.count(F.lit(1)).alias(f"te{g}"), F.count(F.when(~F.col("hit"), 1)).alias(f"unique{g}")) for g, te in ((1, te1), (2, te2))]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(synteny.agg(F.count(F.lit(1)).alias("synteny")), allowMissingColumns=True)
    one = rows.agg(*[F.max(c).alias(c) for c in ("te1", "te2", "synteny", "unique1", "unique2")])
    return one.select(
        "te1",
        "te2",
        "synteny",
        "unique1",
        "unique2",
        percentage(F.col("unique1"), F.col("te1")).alias("pct1"),
        percentage(F.col("unique2"), F.col("te2")).alias("pct2"),
        (F.col("unique1") + F.col("unique2")).alias("total_unique"),
    )
