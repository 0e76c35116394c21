"""Sources: lines of text files, the three formats, and format detection."""

from .annotations import bed, gff3, rejects, synteny
from .detect import detect_format, file_exists, sniff
from .lines import numbered_lines

__all__ = ["bed", "detect_format", "file_exists", "gff3", "numbered_lines", "rejects", "sniff", "synteny"]
