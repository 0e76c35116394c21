"""Which format a file has.  Only the first lines are looked at, on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How many pieces of a file are looked at, and how many bytes a piece has at most.
SNIFFED_LINES, PIECE_BYTES = 10, 1023
# File name endings, in lower case.
ENDINGS = {".gff3": "gff3", ".gff": "gff3", ".bed": "bed"}
#: Tabs from which a line counts as GFF3, or as BED.
GFF3_TABS, BED_TABS = 8, 2


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark reaches has the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sniff(lines: DataFrame) -> DataFrame:
    """(line_no, form) of the first lines that are not comments; form is null where tabs are few.
    The first row with a form decides."""
    tabs = F.size(F.split("value", "\t")) - 1
    form = F.when(tabs >= GFF3_TABS, "gff3").when(tabs >= BED_TABS, "bed")
    return lines.filter(F.col("line_no") <= SNIFFED_LINES).filter(~F.col("value").startswith("#")).select("line_no", form.alias("form"))


def ending_form(name: Column) -> Column:
    """What a file name's ending says, in any case of letters; null if nothing."""
    ending = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    return F.element_at(F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair]), ending)


def pieces(lines: list[str]) -> list[bytes]:
    """The first pieces of a file: lines, long ones cut."""
    out: list[bytes] = []
    for line in lines:
        data = line.encode() + b"\n"
        out += [data[k : k + PIECE_BYTES] for k in range(0, len(data), PIECE_BYTES)]
        if len(out) >= SNIFFED_LINES:
            break
    return out[:SNIFFED_LINES]


def detect_format(spark: SparkSession, path: str) -> str | None:
    """"gff3", "bed" or None.  A name without a dot is not looked into; nor is an empty file."""
    if not file_exists(spark, path):
        return None
    head = [r["value"] for r in spark.read.option("lineSep", "\n").text(path).limit(SNIFFED_LINES).collect()]
    if not head or "." not in path:
        return None
    ending = path[path.rindex(".") :].lower()
    if ending in ENDINGS:
        return ENDINGS[ending]
    for piece in pieces(head):
        if piece.startswith(b"#"):
            continue
        if piece.count(b"\t") >= GFF3_TABS:
            return "gff3"
        if piece.count(b"\t") >= BED_TABS:
            return "bed"
    return None
