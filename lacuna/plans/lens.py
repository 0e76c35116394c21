"""A genomic view of the star-schema tables: the same whole-number expressions, valid in Spark SQL
and in standard SQL, give both engines the same relations.

``syn`` comes from orders, ``te1`` from lineitem (repeated rows stay), ``te2`` from events.  The
``*_lines`` views write rows of events or orders as text, with comments, blank fields, carriage
returns and short rows mixed in.

The SQL has 32-bit coordinates and raises an error beyond; here they have 64 bits, so that large keys
have results too.  ``narrow`` gives results the SQL's type wherever the SQL's can hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYN_RAW = {
    "line_no": "o_orderkey",
    "chr1": "'chr' || CAST(o_custkey % 5 + 1 AS STRING)",
    "a1": "o_orderkey * 1000",
    "b1": "o_orderkey * 1000 + (o_custkey % 40) * 125",
    "chr2": "'chr' || CAST((o_custkey + o_orderkey % 2) % 5 + 1 AS STRING)",
    "a2": "o_orderkey * 1000 + 200",
    "b2": "o_orderkey * 1000 + (o_custkey % 40) * 125 + 200",
    "swapped": "o_orderpriority = '5-LOW'",
    "cents": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey % 100 END",
}
SYN = {
    "line_no": "line_no",
    "chr1": "chr1",
    "start1": "a1",
    "end1": "b1",
    "chr2": "chr2",
    "start2": "a2",
    "end2": "b2",
    "score": "CASE WHEN cents IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(cents AS DOUBLE) / CAST(100 AS DOUBLE) END",
}
TE1 = {
    "chr": "'chr' || CAST(l_suppkey % 5 + 1 AS STRING)",
    "te_start": "l_orderkey * 1000 + l_partkey % 1000",
    "te_end": "l_orderkey * 1000 + l_partkey % 1000 + CAST(l_quantity AS INT) * 10",
    "strand": "CASE WHEN l_returnflag = 'A' THEN '+' WHEN l_returnflag = 'N' THEN '-' ELSE '.' END",
    "type": "CASE l_linenumber WHEN 1 THEN 'LINE' WHEN 2 THEN 'SINE' WHEN 3 THEN 'LTR_retrotransposon' WHEN 4 THEN 'DNA_transposon' WHEN 5 THEN 'helitron' WHEN 6 THEN 'INTERGENIC' ELSE 'gene' END",
    "family": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'fam' || CAST(l_partkey % 7 AS STRING) END",
}
TE2 = {
    "line_no": "event_id + 1",
    "chr": "'chr' || CAST(user_id % 5 + 1 AS STRING)",
    "te_start": "event_id * 1500 + user_id % 1000 + 1",
    "te_end": "event_id * 1500 + user_id % 1000 + event_id % 50",
    "strand": "CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END",
    "type": "event_type",
    "family": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'fam' || CAST(user_id % 4 AS STRING) END",
}
#: GFF3 rows from events: what the text holds.
GFF = {
    "line_no": "event_id + 1",
    "chr": "'chr' || CAST(user_id % 5 + 1 AS STRING)",
    "te_start": "event_id * 1500 + user_id % 1000",
    "te_end": "event_id * 1500 + user_id % 1000 + event_id % 50",
    "strand": "CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END",
    "type": "CASE event_id % 8 WHEN 0 THEN 'LINE' WHEN 1 THEN 'gene' WHEN 2 THEN 'SINE' WHEN 3 THEN 'INTERGENIC' WHEN 4 THEN 'Helitron' WHEN 5 THEN 'MITE' WHEN 6 THEN 'DNAxtransposon' ELSE 'LTR_retrotransposon' END",
    "own_id": "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '' ELSE 'id' || CAST(event_id AS STRING) END",
    "own_name": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'n=' || CAST(user_id AS STRING) END",
    "family": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'late' || CAST(user_id % 3 AS STRING) ELSE 'fam' || CAST(user_id % 4 AS STRING) END",
    "early": "event_id % 10 = 1",
    "key": "event_id",
}
#: Coordinates, of 32 bits in the SQL and of 64 here.
COORDINATES = ("te_start", "te_end", "start1", "end1", "start2", "end2")
# Kinds of noise by key: a comment, a short row, doubled tabs, a carriage return.
COMMENT, SHORT, DOUBLED, RETURN = 13, 17, 7, 11
NOT_ROWS = f"(key % {COMMENT} = 0 OR key % {SHORT} = 0)"
_TABLES = {"syn_raw": ("orders", SYN_RAW), "te1": ("lineitem", TE1), "te2": ("events", TE2), "gff": ("events", GFF)}


def _items(columns: dict[str, str], kind: str) -> list[str]:
    return [f"CAST({e} AS {kind}) AS {c}" if c in COORDINATES else f"{e} AS {c}" for c, e in columns.items()]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the structured relations."""
    if name == "syn":
        return view(spark, sf_dir, "syn_raw").selectExpr(*_items(SYN, "BIGINT"))
    table, columns = _TABLES[name]
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").selectExpr(*_items(columns, "BIGINT"))


def narrow(result: DataFrame, whole: DataFrame, added: int = 0) -> DataFrame:
    """``result`` with the SQL's 32-bit coordinates if all those of ``whole``, a view, fit them with
    ``added`` put on top: wherever the SQL has a result.  Else they stay as they are."""
    held = [c for c in whole.columns if c in COORDINATES]
    least, most = whole.agg(F.min(F.least(*held)), F.max(F.greatest(*held))).first()
    return result if least is not None and not -(2**31) <= least <= most + added < 2**31 else with_32_bits(result)


def with_32_bits(result: DataFrame) -> DataFrame:
    return result.withColumns({c: F.col(c).cast("int") for c in result.columns if c in COORDINATES})


def ctes() -> str:
    """The same relations for a WITH clause."""
    one = lambda name, table, cols: f"{name} AS (SELECT {', '.join(_items(cols, 'INT'))} FROM {table})"
    return ", ".join([*(one(n, t, c) for n, (t, c) in _TABLES.items()), one("syn", "syn_raw", SYN)])


def _noisy(key: str, fields: list, short: int) -> F.Column:
    """A row as text, with noise by its key."""
    k = F.col(key)
    tab = F.when(k % DOUBLED == 0, "\t\t").otherwise("\t")
    joined = lambda xs: F.array_join(F.array(*[F.coalesce(F.concat(x, tab), F.lit("")) for x in xs[:-1]], F.coalesce(xs[-1], F.lit(""))), "")
    whole = F.when(k % DOUBLED == 0, F.lit("\t")).otherwise(F.lit(""))
    row = F.concat(whole, joined(fields))
    ended = F.when(k % RETURN == 0, F.concat(row, F.lit("\rrest\tof\tline"))).otherwise(row)
    return F.when(k % COMMENT == 0, F.concat(F.lit("#"), row)).when(k % SHORT == 0, joined(fields[:short])).otherwise(ended)


def _lines(rows: DataFrame, value: F.Column) -> DataFrame:
    """(line_no, value), the text as a plain column: parsers must not be rewritten in its terms."""
    return rows.select(F.inline(F.array(F.struct("line_no", value.alias("value")))))


def gff3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "gff")
    part = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}="), c), F.lit(""))
    # An earlier ID and family are overridden by the last ones; other keys and spaces are noise.
    attributes = F.concat_ws(
        ";",
        F.when(F.col("own_id").isNotNull(), F.lit("ID=first")).otherwise(F.lit("id=x")),
        F.when(F.col("early"), F.lit(" family=first")).otherwise(F.lit("Note=a=b")),
        part("  ID", F.col("own_id")),
        part("Name", F.col("own_name")),
        F.when(F.col("early"), part("TE_family", F.col("family"))).otherwise(part("family", F.col("family"))),
    )
    number = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("x"))
    fields = [F.col("chr"), F.lit("src"), F.col("type"), number("te_start"), number("te_end"), F.lit("."), F.col("strand"), F.lit("."), attributes]
    return _lines(g, _noisy("key", fields, 8))


def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows have 3 to 7 fields, by key."""
    g = view(spark, sf_dir, "gff")
    n = F.col("key") % 5 + 3
    fields = [F.col("chr"), F.col("te_start").cast("string"), F.col("te_end").cast("string")]
    fields += [F.when(n > k, x) for k, x in enumerate((F.concat(F.lit("n"), F.col("key").cast("string")), F.lit("100"), F.col("strand"), F.col("type")), 3)]
    track = F.when(F.col("key") % 19 == 0, F.lit("track name=x\ty\tz")).otherwise(_noisy("key", fields, 2))
    return _lines(g, track)


def synteny_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "syn_raw")
    ends = lambda g: [F.when(F.col("swapped"), F.col(f"b{g}")).otherwise(F.col(f"a{g}")).cast("string"), F.when(F.col("swapped"), F.col(f"a{g}")).otherwise(F.col(f"b{g}")).cast("string")]
    score = F.concat((F.col("cents").cast("double") / 100).cast("string"), F.lit("z"))
    fields = [F.col("chr1"), *ends(1), F.col("chr2"), *ends(2), score]
    return _lines(s, _noisy("line_no", fields, 5))
