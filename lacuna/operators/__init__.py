"""Operators on relations: interval joins, counts, previews."""

from .counts import count_by, relation_counts, summary
from .overlap import in_synteny, marked, side, unique
from .preview import preview

__all__ = ["count_by", "in_synteny", "marked", "preview", "relation_counts", "side", "summary", "unique"]
