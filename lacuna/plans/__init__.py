"""Whole plans: the comparison of two genomes, and the registered queries."""

from .compare import Comparison, compare

__all__ = ["Comparison", "compare"]
