"""Text rules, as expressions over columns.  No rule needs a user function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# An annotation row is an element if its type holds one of these, case-sensitively.
ELEMENT_TYPES = ("transposable_element", "TE", "retrotransposon", "DNA_transposon", "LINE", "SINE", "LTR", "TIR", "MITE", "helitron")
#: White space that a number may start with.
_SPACE = r"[\x20\x09\x0A\x0B\x0C\x0D]*"


def is_skipped(line: Column) -> Column:
    """Comment and blank lines, told by the first character of the raw line."""
    return line.startswith("#") | line.startswith("\r") | (line == "")


def is_track(line: Column) -> Column:
    """Display lines of BED files; a chromosome whose name starts with "track" falls under it too."""
    return line.startswith("track")


def cut_line(line: Column) -> Column:
    """A line ends at its first carriage return."""
    return F.substring_index(line, "\r", 1)


def tokens(line: Column, most: int) -> Column:
    """Fields between tabs.  Runs of tabs count as one, so there are no empty fields; fields beyond
    ``most`` are left out."""
    return F.slice(F.filter(F.split(line, "\t"), lambda x: x != ""), 1, most)


def token(fields: Column, k: int) -> Column:
    """Field k (from 0), null if there are fewer."""
    return F.get(fields, F.lit(k))


def c_int(text: Column) -> Column:
    """The longest whole-number prefix; 0 if there is none or it does not fit 32 bits."""
    return F.coalesce(F.regexp_extract(text, rf"^{_SPACE}([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def coordinate(text: Column) -> Column:
    """The longest whole-number prefix; 0 if there is none or it has more than 18 digits, so that
    differences of two fit 64 bits."""
    whole = F.regexp_extract(text, rf"^{_SPACE}([+-]?0*[0-9]{{1,18}})(?![0-9])", 1)
    return F.coalesce(whole.try_cast("bigint"), F.lit(0).cast("bigint"))


def c_float(text: Column) -> Column:
    """The longest decimal prefix, with an exponent if it is whole; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, rf"^{_SPACE}([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def gff_attribute(attributes: Column, *keys: str) -> Column:
    """The value of the last attribute with one of the keys, null if there is none.

    Attributes stand between semicolons; spaces before a key do not count; the first equals sign
    ends the key; the value is taken as it stands.
    """
    stripped = F.transform(F.split(attributes, ";"), lambda x: F.ltrim(x))
    held = F.filter(stripped, lambda x: reduce(lambda a, b: a | b, [x.startswith(f"{k}=") for k in keys]))
    last = F.try_element_at(held, F.lit(-1))
    return F.substring(last, F.locate("=", last) + 1, F.length(last))


def generated_id(line_no: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", F.lit("TE"), line_no.cast("string"), start.cast("string"), end.cast("string"))


def is_element_type(kind: Column) -> Column:
    return reduce(lambda a, b: a | b, [kind.contains(x) for x in ELEMENT_TYPES])
