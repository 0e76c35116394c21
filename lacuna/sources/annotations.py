"""Parsers: line tables (line_no, value) to relations.

They take lines, not paths, so files and tables of text are read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import c_float, coordinate, cut_line, generated_id, gff_attribute, is_element_type, is_skipped, is_track, token, tokens

#: Fields that are read at most, and that a row must have.
MOST = {"synteny": 10, "gff3": 10, "bed": 15}
LEAST = {"synteny": 6, "gff3": 9, "bed": 3}


def _settled(df: DataFrame, *columns: Column) -> DataFrame:
    """A projection whose results are plain columns to everything above.

    Filters and join conditions over ``columns`` would otherwise be rewritten in terms of the whole
    parsing expressions, again and again, until plans no longer fit the driver.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def _fields(lines: DataFrame, form: str) -> DataFrame:
    """(line_no, t) of the lines that are rows at all."""
    line = F.col("value")
    skipped = is_skipped(line) | is_track(line) if form == "bed" else is_skipped(line)
    return _settled(lines.filter(~skipped), F.col("line_no"), tokens(cut_line(line), MOST[form]).alias("t"))


def rejects(lines: DataFrame, form: str) -> DataFrame:
    """(line_no, n_tokens) of rows that have too few fields."""
    return _fields(lines, form).select("line_no", F.size("t").alias("n_tokens")).filter(F.col("n_tokens") < LEAST[form])


def _rows(lines: DataFrame, form: str) -> DataFrame:
    return _fields(lines, form).filter(F.size("t") >= LEAST[form])


def _or(k: int, default: Column) -> Column:
    """Field k, or a default where the row ends before it."""
    return F.coalesce(token(F.col("t"), k), default)


def synteny(lines: DataFrame) -> DataFrame:
    """Blocks; the ends of either side are put in order, a missing score is 1."""
    t = F.col("t")
    a1, b1, a2, b2 = (coordinate(token(t, k)) for k in (1, 2, 4, 5))
    score = F.when(F.size(t) > 6, c_float(token(t, 6))).otherwise(F.lit(1.0))
    return _settled(
        _rows(lines, "synteny"),
        F.col("line_no"),
        token(t, 0).alias("chr1"),
        F.least(a1, b1).alias("start1"),
        F.greatest(a1, b1).alias("end1"),
        token(t, 3).alias("chr2"),
        F.least(a2, b2).alias("start2"),
        F.greatest(a2, b2).alias("end2"),
        score.alias("score"),
    )


def gff3(lines: DataFrame) -> DataFrame:
    """Elements of GFF3 rows whose type is an element's.  Coordinates stay as they are."""
    t = F.col("t")
    own = _settled(
        _rows(lines, "gff3").filter(is_element_type(token(t, 2))),
        F.col("line_no"),
        token(t, 0).alias("chr"),
        coordinate(token(t, 3)).alias("te_start"),
        coordinate(token(t, 4)).alias("te_end"),
        token(t, 6).alias("strand"),
        token(t, 2).alias("type"),
        gff_attribute(token(t, 8), "family", "TE_family").alias("family"),
        gff_attribute(token(t, 8), "ID").alias("own_id"),
        gff_attribute(token(t, 8), "Name").alias("own_name"),
    )
    named = F.coalesce("own_id", generated_id(F.col("line_no"), F.col("te_start"), F.col("te_end")))
    return own.select("line_no", named.alias("id"), "chr", "te_start", "te_end", "strand", "type", "family", F.coalesce("own_name", named).alias("name"))


def bed(lines: DataFrame) -> DataFrame:
    """Elements of BED rows, of whatever type; starts become 1-based.  The family is unknown."""
    t = F.col("t")
    own = _settled(_rows(lines, "bed"), F.col("line_no"), t, (coordinate(token(t, 1)) + 1).alias("te_start"), coordinate(token(t, 2)).alias("te_end"))
    made = generated_id(F.col("line_no"), F.col("te_start"), F.col("te_end"))
    return own.select(
        "line_no",
        made.alias("id"),
        token(t, 0).alias("chr"),
        "te_start",
        "te_end",
        _or(5, F.lit(".")).alias("strand"),
        _or(6, F.lit("transposable_element")).alias("type"),
        F.lit(None).cast("string").alias("family"),
        _or(3, made).alias("name"),
    )


PARSERS = {"gff3": gff3, "bed": bed}
