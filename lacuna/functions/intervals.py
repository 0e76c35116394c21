"""Interval tests on closed intervals."""

from __future__ import annotations

from pyspark.sql import Column


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Closed intervals that share a place; touching ends do.  Applied as it stands to inverted ones."""
    return (other_start <= end) & (other_end >= start)


def is_inverted(start: Column, end: Column) -> Column:
    return start > end
