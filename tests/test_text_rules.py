"""Text rules on edge cases written out by hand."""

import pytest
from pyspark.sql import functions as F

from lacuna.functions import c_float, c_int, gff_attribute, is_element_type, is_skipped, tokens
from lacuna.sources.annotations import bed, gff3, rejects, synteny


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line_no long, value string")


@pytest.mark.parametrize(
    "text, whole, decimal",
    [("12abc", 12, 12.0), ("abc", 0, 0.0), (" +7", 7, 7.0), ("-3.5e1x", -3, -35.0), ("", 0, 0.0), (".5", 0, 0.5), ("99999999999", 0, 99999999999.0), ("1e", 1, 1.0), ("\x0b\f9", 9, 9.0)],
)
def test_numbers(spark, text, whole, decimal):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(c_int(F.col("t")), c_float(F.col("t"))).first() == (whole, decimal)


def test_tokens(spark):
    df = spark.createDataFrame([("\ta\t\tb c\t",), ("",), ("\t\t",)], "v string")
    assert [r[0] for r in df.select(tokens(F.col("v"), 10)).collect()] == [["a", "b c"], [], []]
    assert df.select(tokens(F.lit("\t".join("abcdefghijkl")), 10)).first()[0] == list("abcdefghij")


def test_skipped_lines(spark):
    df = lines(spark, "#x", " #x", "", "\rx", "x")
    assert [r[0] for r in df.select(is_skipped(F.col("value"))).collect()] == [True, False, True, True, False]


@pytest.mark.parametrize(
    "text, ident, name, family",
    [
        ("ID=a;ID=b", "b", None, None),
        ("family=x;TE_family=y", None, None, "y"),
        ("TE_family=y;family=x", None, None, "x"),
        ("ID=;family=", "", None, ""),
        ("Name=a=b", None, "a=b", None),
        ("id=a", None, None, None),
        ("ID =a", None, None, None),
        (";;  ID=a;", "a", None, None),
        ("\tID=a", None, None, None),
        ("ID", None, None, None),
    ],
)
def test_attributes(spark, text, ident, name, family):
    df = spark.createDataFrame([(text,)], "a string")
    a = F.col("a")
    assert df.select(gff_attribute(a, "ID"), gff_attribute(a, "Name"), gff_attribute(a, "family", "TE_family")).first() == (ident, name, family)


def test_element_types(spark):
    kinds = ["INTERGENIC", "Helitron", "helitron", "gene", "DNAxtransposon", "DNA_transposon"]
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    assert [r[0] for r in df.select(is_element_type(F.col("t"))).collect()] == [True, False, True, False, False, True]


def test_gff3(spark):
    row = "c\ts\t{}\t{}\t{}\t.\t+\t.\t{}"
    df = lines(spark, "# x", row.format("LINE", "20x", "abc", "family=f"), row.format("gene", 1, 2, "ID=g"), "c\ts\tLINE\t1\t2\t.\t+\t.", row.format("SINE", 9, 3, "ID=;Name=n") + "\r\tjunk")
    got = [tuple(r) for r in gff3(df).orderBy("line_no").collect()]
    assert got == [(2, "TE_2_20_0", "c", 20, 0, "+", "LINE", "f", "TE_2_20_0"), (5, "", "c", 9, 3, "+", "SINE", None, "n")]
    assert [tuple(r) for r in rejects(df, "gff3").collect()] == [(4, 8)]


def test_bed(spark):
    df = lines(spark, "track name=x", "c\t1\t\t5", "c\t100\t100\tn", "c\t1", "#c\t1\t2", "c\t7\t9\tn\t0\t-\tkind\r", "track1\t5\t9")
    got = [tuple(r) for r in bed(df).orderBy("line_no").collect()]
    assert got == [
        (2, "TE_2_2_5", "c", 2, 5, ".", "transposable_element", None, "TE_2_2_5"),
        (3, "TE_3_101_100", "c", 101, 100, ".", "transposable_element", None, "n"),
        (6, "TE_6_8_9", "c", 8, 9, "-", "kind", None, "n"),
    ]
    assert [tuple(r) for r in rejects(df, "bed").collect()] == [(4, 2)]


def test_synteny(spark):
    df = lines(spark, "a\t500\t100\tb\t1\t9", "a\t1\t2\tb\t9\t1\t0.5z", "a\t1\t2\tb\t9")
    got = [tuple(r) for r in synteny(df).orderBy("line_no").collect()]
    assert got == [(1, "a", 100, 500, "b", 1, 9, 1.0), (2, "a", 1, 2, "b", 1, 9, 0.5)]
