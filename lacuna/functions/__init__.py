"""Column functions: the exact text rules of the annotation formats, and interval tests."""

from .intervals import is_inverted, overlaps
from .text import c_float, c_int, coordinate, cut_line, generated_id, gff_attribute, is_element_type, is_skipped, is_track, token, tokens

__all__ = ["c_float", "c_int", "coordinate", "cut_line", "generated_id", "gff_attribute", "is_element_type", "is_inverted", "is_skipped", "is_track", "overlaps", "token", "tokens"]
