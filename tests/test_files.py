"""Whole files: line numbers, format detection, the comparison, the command line."""

from pathlib import Path

import pytest

from lacuna.cli import Arguments, UsageError, main, parse_arguments
from lacuna.plans import compare
from lacuna.sources import detect_format, numbered_lines
from lacuna.sources.annotations import bed, gff3, synteny
from lacuna.sources.report import one_decimal, write_report_folder

HERE = Path(__file__).parent / "fixtures"
FILES = [str(HERE / f) for f in ("synteny.txt", "genome1.gff3", "genome2.bed")]


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("".join(f"{i}{'#' * (i % 50)}\n" for i in range(1, 20001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        (tmp_path / "y.txt").write_text("".join(f"{i}\n" for i in range(1, 9001)))
        df = numbered_lines(spark, str(path))
        both = numbered_lines(spark, str(tmp_path))
        assert both.filter("line_no <> int(regexp_extract(value, '^[0-9]+', 0))").count() == 0 and both.count() == 29000
        assert df.filter("line_no <> int(regexp_extract(value, '^[0-9]+', 0))").count() == 0 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_golden_sample(spark):
    blocks, te1, te2 = synteny(numbered_lines(spark, FILES[0])), gff3(numbered_lines(spark, FILES[1])), bed(numbered_lines(spark, FILES[2]))
    c = compare(te1, te2, blocks)
    assert [r.id for r in c.unique1.orderBy("line_no").collect()] == ["TE001", "TE004", "TE010", "TE011", "TE012", "TE013"]
    assert [(r.id, r.name) for r in c.unique2.orderBy("line_no").collect()] == [
        ("TE_6_8701_9400", "TE004"), ("TE_12_14301_14800", "TE010"), ("TE_14_20001_20500", "TE014"), ("TE_15_18001_18800", "TE015"), ("TE_16_25001_25300", "TE016"), ("TE_17_15001_15500", "TE017"), ("TE_18_20001_20500", "TE018")
    ]
    s = c.summary.first()
    assert (s.te1, s.te2, s.synteny, s.unique1, s.unique2, s.total_unique) == (13, 15, 10, 6, 7, 13)
    assert (one_decimal(s.pct1), one_decimal(s.pct2)) == ("46.2", "46.7")
    assert [(r.type, r.n) for r in c.types1.collect()] == [("transposable_element", 2), ("LINE", 2), ("DNA_transposon", 1), ("SINE", 1)]
    assert [(r.type, r.n) for r in c.types2.collect()] == [("LINE", 2), ("DNA_transposon", 2), ("transposable_element", 1), ("SINE", 1), ("helitron", 1)]
    assert [(r.family, r.n) for r in c.families1.collect()] == [("DNA_transposon", 2), ("L1", 2), ("hAT", 1), ("Alu", 1)]
    assert [(r.family, r.n) for r in c.families2.collect()] == [("unknown", 7)]
    everything = compare(te1, te2)
    assert everything.unique1.count() == 13 and everything.summary.first().pct1 == 100.0


@pytest.mark.parametrize(
    "name, text, form",
    [("x.GFF", "a", "gff3"), ("x.gff3", "a", "gff3"), ("x.bed", "a", "bed"), ("x.txt", "#\n" + "a\t" * 9, "gff3"), ("x.txt", "a\tb\tc", "bed"), ("x.txt", "a b", None), ("x.bed", "", None), ("x.txt", "#\t\t\n" * 10 + "a\tb\tc", None)],
)
def test_detection(spark, tmp_path, name, text, form):
    (tmp_path / name).write_text(text)
    assert detect_format(spark, str(tmp_path / name)) == form


def test_detection_by_pieces(spark, tmp_path):
    """Lines over 1,023 bytes count as several of the ten pieces, each with its own tabs."""
    for text, form in [("x" * 1023 + "\t" * 9, "gff3"), ("\t" + "x" * 1022 + "\ta", None), ("x" * 1023 * 10 + "\t\t\t", None), ("x" * 1023 * 9 + "\t\t\t", "bed"), ("x" * 1023 + "#\t\t\t", None)]:
        (tmp_path / "x.txt").write_text(text)
        assert detect_format(spark, str(tmp_path / "x.txt")) == form


def test_detection_without_dot(spark, tmp_path, monkeypatch):
    assert detect_format(spark, str(tmp_path / "none.bed")) is None
    monkeypatch.chdir(tmp_path)
    Path("plain").write_text("a\tb\tc")
    assert detect_format(spark, f"file:{tmp_path}/plain") is None


def test_command_line(spark, tmp_path, capsys):
    prefix = str(tmp_path / "out")
    assert main([*FILES, "-v", "-o", prefix], spark) == 0
    text = capsys.readouterr().out
    for part in ("Parsed 10 synteny blocks", "Parsed 13 transposons from GFF3", "Parsed 15 transposons from BED", "Genome 1 unique transposons: 6 (46.2% of total)", "Genome 2 unique transposons: 7 (46.7% of total)", "  unknown: 7", "Total unique transposons identified: 13", "chr1\t1000\t5000\tchr1\t1000\t5000\t0.95"):
        assert part in text
    rows = Path(f"{prefix}_genome2_unique.txt").read_text().split("\n")
    assert rows[:3] == ["# Unique transposons in Genome 2", "# ID\tChr\tStart\tEnd\tStrand\tType\tFamily\tName", "TE_6_8701_9400\tchr2\t8701\t9400\t+\tLINE\tN/A\tTE004"]
    assert len(rows) == 10 and rows[-1] == ""


def test_exit_codes(spark, tmp_path, capsys):
    empty = tmp_path / "e.bed"
    empty.write_text("")
    comments = tmp_path / "c.bed"
    comments.write_text("# nothing\n")
    assert main(["--help"], spark) == 0 and main([], spark) == 1 and main([*FILES, "--what"], spark) == 1
    assert main([FILES[0], "/no/such/file", FILES[2]], spark) == 1
    assert main([FILES[0], str(empty), FILES[2]], spark) == 1
    assert main([*FILES, "-o", "/no/such/folder/x"], spark) == 1
    capsys.readouterr()
    assert main([FILES[0], str(comments), FILES[2], "-o", str(tmp_path / "x")], spark) == 0
    assert "Genome 1 unique transposons: 0 (0.0% of total)" in capsys.readouterr().out
    assert len((tmp_path / "x_genome1_unique.txt").read_text().split("\n")) == 3


def test_arguments():
    assert parse_arguments(["a", "b", "c", "g1", "g2", "-o", "p", "-v"]) == Arguments("a", "b", "c", "g1", "g2", "p", True)
    assert parse_arguments(["-x", "b", "c"]).synteny == "-x" and parse_arguments(["a", "-h"]).help
    for bad in (["a", "b"], ["a", "b", "c", "-o"], ["a", "b", "c", "-v", "late"]):
        with pytest.raises(UsageError):
            parse_arguments(bad)


def test_report_folder(spark, tmp_path):
    write_report_folder(bed(numbered_lines(spark, FILES[2])), str(tmp_path / "r"))
    rows = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(rows) == 15 and all(r.count("\t") == 7 for r in rows)
