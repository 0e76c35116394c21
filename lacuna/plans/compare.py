"""The comparison of two genomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import count_by, marked, side, summary, unique
from ..schemas import SYNTENY


@dataclass(frozen=True)
class Comparison:
    """All results, as lazy DataFrames."""

    unique1: DataFrame
    unique2: DataFrame
    summary: DataFrame
    types1: DataFrame
    types2: DataFrame
    families1: DataFrame
    families2: DataFrame


def compare(te1: DataFrame, te2: DataFrame, synteny: DataFrame | None = None, strategy: str = "auto") -> Comparison:
    """The elements of either genome outside its synteny blocks, counted.  Without blocks all are."""
    if synteny is None:
        synteny = te1.sparkSession.createDataFrame([], SYNTENY)
    u1, u2 = unique(te1, side(synteny, 1), strategy), unique(te2, side(synteny, 2), strategy)
    counted = [count_by(u, key, "line_no").orderBy("first_seen") for key in ("type", "family") for u in (u1, u2)]
    return Comparison(u1, u2, summary(marked(te1, side(synteny, 1)), marked(te2, side(synteny, 2)), synteny), *counted)
