"""The registered queries of the engine, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cli import Arguments, UsageError, parse_arguments
from ..functions import c_float, c_int, cut_line, generated_id, gff_attribute, is_element_type, is_skipped, is_track, overlaps, tokens
from ..functions.text import ELEMENT_TYPES
from ..operators import count_by, in_synteny, marked, relation_counts, side, summary, unique
from ..operators.preview import ELEMENT_ROWS, SYNTENY_ROWS, element_preview, synteny_preview
from ..schemas import SYNTENY
from ..sources.annotations import LEAST, bed, gff3, rejects, synteny
from ..sources.detect import BED_TABS, GFF3_TABS, SNIFFED_LINES, ending_form, sniff
from ..sources.report import numbered, report_rows, summary_lines
from . import lens

Query = Callable[[SparkSession, str], DataFrame]
_TE = ("chr", "te_start", "te_end", "strand", "type", "family")


def _te(spark: SparkSession, d: str, genome: int) -> DataFrame:
    return lens.view(spark, d, f"te{genome}").select(*_TE)


def _blocks(spark: SparkSession, d: str, genome: int) -> DataFrame:
    return side(lens.view(spark, d, "syn"), genome)


def _of_te(operator: Callable[[DataFrame, DataFrame], DataFrame], genome: int, blocks: int | None = None) -> Query:
    """A query for those elements of a genome that an operator keeps, by the blocks on a side."""
    return lambda s, d: lens.narrow(operator(_te(s, d, genome), _blocks(s, d, blocks or genome)), _te(s, d, genome))


def _by(strategy: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda elements, blocks: unique(elements, blocks, strategy)


def _both(spark: SparkSession, d: str) -> DataFrame:
    parts = [unique(_te(spark, d, g), _blocks(spark, d, g)).select(F.lit(g).alias("genome"), *_TE) for g in (1, 2)]
    return parts[0].unionByName(parts[1])


def unique_all(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: unique elements of both genomes."""
    return lens.narrow(_both(spark, d), _te(spark, d, 1).unionByName(_te(spark, d, 2)))


def _counts(key: str) -> Query:
    return lambda s, d: _both(s, d).groupBy("genome", F.coalesce(key, F.lit("unknown")).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def _first_seen(key: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        u = unique(lens.view(spark, d, "te2"), _blocks(spark, d, 2))
        return count_by(u, key, "line_no")

    return run


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(*(marked(_te(spark, d, g), _blocks(spark, d, g)) for g in (1, 2)), lens.view(spark, d, "syn"))


def _relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return relation_counts(te1=_te(spark, d, 1), te2=_te(spark, d, 2), synteny=lens.view(spark, d, "syn"))


_EDGES = [(1, 1, 10, 10, 20), (2, 1, 10, 11, 20), (3, 21, 30, 10, 20), (4, 20, 30, 10, 20), (5, 101, 100, 100, 101), (6, 101, 100, 101, 200), (7, 12, 15, 10, 20), (8, 5, 25, 10, 20), (9, 15, 12, 10, 20)]


def _edges(spark: SparkSession, d: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("k", "s", "e", "bs", "be")])
    return spark.createDataFrame(_EDGES, schema).select("k", overlaps(F.col("s"), F.col("e"), F.col("bs"), F.col("be")).alias("hit"))


def _syn_parsed(spark: SparkSession, d: str) -> DataFrame:
    return synteny(lens.synteny_lines(spark, d))


def _previewed(head: DataFrame) -> DataFrame:
    """A preview's rows; coordinates have 32 bits where these rows' fit them."""
    rows = head.collect()
    fit = all(-(2**31) <= r[c] < 2**31 for r in rows for c in head.columns if c in lens.COORDINATES)
    shown = head.sparkSession.createDataFrame(rows, head.schema)
    return lens.with_32_bits(shown) if fit else shown


def _tokenise(spark: SparkSession, d: str) -> DataFrame:
    lines = lens.bed_lines(spark, d)
    return lines.select("line_no", F.array_join(tokens(cut_line(F.col("value")), 15), "|").alias("fields"))


#: Numbers with other text before and after them.
_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS STRING) || 'abc' WHEN 1 THEN 'abc' || CAST(o_custkey AS STRING) WHEN 2 THEN ' +' || CAST(o_custkey AS STRING) WHEN 3 THEN '-' || CAST(o_custkey AS STRING) || '.75e1x' WHEN 4 THEN '99999999999' ELSE '.' || CAST(o_custkey AS STRING) END"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/orders.parquet").selectExpr("o_orderkey AS k", f"{_TEXT} AS t")


def _sniffed(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of the three kinds of text, each numbered by rank."""
    parts = []
    for name, make in (("gff3", lens.gff3_lines), ("bed", lens.bed_lines)):
        parts.append(sniff(make(spark, d)).select(F.lit(name).alias("kind"), "line_no", "form"))
    return parts[0].unionByName(parts[1])


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(cut_line(F.col("value")), 10)
    a = F.get(t, F.lit(8))
    kept = lens.gff3_lines(spark, d).filter(~is_skipped(F.col("value")) & (F.size(t) >= 9))
    return kept.select("line_no", gff_attribute(a, "ID").alias("own_id"), gff_attribute(a, "Name").alias("own_name"), gff_attribute(a, "family", "TE_family").alias("family"))


#: File names with all endings, by key.
_NAME = "'f.x' || CAST(p_partkey AS STRING) || CASE p_partkey % 8 WHEN 0 THEN '.GFF3' WHEN 1 THEN '.gff' WHEN 2 THEN '.Bed' WHEN 3 THEN '.txt' WHEN 4 THEN '' WHEN 5 THEN '.gff3.bak' WHEN 6 THEN '.bed ' ELSE '.gFf' END"


def _endings(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d.rstrip('/')}/part.parquet").selectExpr("p_partkey AS k", f"{_NAME} AS name")
    return names.select("k", ending_form(F.col("name")).alias("form"))


#: Command lines, and what they mean: synteny, te1, te2, genome1, genome2, prefix, verbose, help, error.
_COMMANDS = [
    ("s a b", ("s", "a", "b", None, None, "te_comparison", False, False, None)),
    ("s a b -v", ("s", "a", "b", None, None, "te_comparison", True, False, None)),
    ("s a b g1", ("s", "a", "b", "g1", None, "te_comparison", False, False, None)),
    ("s a b g1 g2 -o p --verbose", ("s", "a", "b", "g1", "g2", "p", True, False, None)),
    ("s a b --output p -o q", ("s", "a", "b", None, None, "q", False, False, None)),
    ("-v a b", ("-v", "a", "b", None, None, "te_comparison", False, False, None)),
    ("s a", (None, None, None, None, None, None, None, None, "")),
    ("", (None, None, None, None, None, None, None, None, "")),
    ("s a b -x", (None, None, None, None, None, None, None, None, "Error: Unknown option -x")),
    ("s a b -o", (None, None, None, None, None, None, None, None, "Error: Unknown option -o")),
    ("s a b g1 g2 g3", (None, None, None, None, None, None, None, None, "Error: Unknown option g3")),
    ("s a b -v g1", (None, None, None, None, None, None, None, None, "Error: Unknown option g1")),
    ("s a b -x --help", ("", "", "", None, None, "te_comparison", False, True, None)),
    ("-h", ("", "", "", None, None, "te_comparison", False, True, None)),
]
_ARGUMENTS = "synteny string, te1 string, te2 string, genome1 string, genome2 string, prefix string, is_verbose boolean, is_help boolean, message string"


def _commands(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for line, _ in _COMMANDS:
        try:
            a: Arguments = parse_arguments(line.split())
            rows.append((line, a.synteny, a.te1, a.te2, a.genome1, a.genome2, a.prefix, a.verbose, a.help, None))
        except UsageError as e:
            rows.append((line, *[None] * 8, str(e)))
    return spark.createDataFrame(rows, f"line string, {_ARGUMENTS}")


def _console(spark: SparkSession, d: str) -> DataFrame:
    lines = summary_lines(_summary(spark, d).first())
    return spark.createDataFrame(list(enumerate(lines, 1)), "n int, line string")


def queries() -> dict[str, Query]:
    return {
        "unique_all": unique_all,
        "unique_genome1": _of_te(unique, 1),
        "unique_genome2": _of_te(unique, 2),
        "in_synteny_genome1": _of_te(in_synteny, 1),
        "in_synteny_genome2": _of_te(in_synteny, 2),
        "unique_broadcast_genome2": _of_te(_by("broadcast"), 2),
        "unique_sweep_genome1": _of_te(_by("sweep"), 1),
        "unique_sweep_genome2": _of_te(_by("sweep"), 2),
        "unique_binned_genome1": _of_te(_by("binned"), 1),
        "unique_no_synteny": lambda s, d: lens.narrow(unique(_te(s, d, 1), side(s.createDataFrame([], SYNTENY), 1)), _te(s, d, 1)),
        "unique_other_side": _of_te(unique, 1, blocks=3),
        "overlap_edge_cases": _edges,
        "type_counts": _counts("type"),
        "family_counts": _counts("family"),
        "type_counts_first_seen": _first_seen("type"),
        "family_counts_first_seen": _first_seen("family"),
        "unique_summary": _summary,
        "relation_counts": _relation_counts,
        "synteny_parse": lambda s, d: lens.narrow(_syn_parsed(s, d), lens.view(s, d, "syn")),
        "synteny_normalised": lambda s, d: lens.narrow(_syn_parsed(s, d).select("line_no", "start1", "end1", "start2", "end2"), lens.view(s, d, "syn")),
        "synteny_default_score": lambda s, d: _syn_parsed(s, d).filter("score = 1").select("line_no", "score"),
        "gff3_parse": lambda s, d: lens.narrow(gff3(lens.gff3_lines(s, d)), lens.view(s, d, "gff")),
        "gff3_type_filter": lambda s, d: gff3(lens.gff3_lines(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
        "gff3_attributes": _attributes,
        "gff3_generated_ids": lambda s, d: gff3(lens.gff3_lines(s, d)).filter(F.col("id").startswith("TE_")).select("line_no", "id", "name"),
        "bed_parse": lambda s, d: lens.narrow(bed(lens.bed_lines(s, d)), lens.view(s, d, "gff"), added=1),
        "bed_arity_defaults": lambda s, d: bed(lens.bed_lines(s, d)).select("line_no", "strand", "type", "name"),
        "bed_generated_ids": lambda s, d: bed(lens.bed_lines(s, d)).select("line_no", "id"),
        "line_filter": lambda s, d: lens.bed_lines(s, d).filter(~is_skipped(F.col("value")) & ~is_track(F.col("value"))).select("line_no"),
        "arity_rejects": lambda s, d: rejects(lens.gff3_lines(s, d), "gff3").withColumn("form", F.lit("gff3")).unionByName(rejects(lens.synteny_lines(s, d), "synteny").withColumn("form", F.lit("synteny"))).unionByName(rejects(lens.bed_lines(s, d), "bed").withColumn("form", F.lit("bed"))),
        "tokenise_collapse": _tokenise,
        "c_int_coercion": lambda s, d: _orders(s, d).select("k", c_int(F.col("t")).alias("v")),
        "c_float_coercion": lambda s, d: _orders(s, d).select("k", c_float(F.col("t")).alias("v")),
        "element_type_substring": lambda s, d: lens.view(s, d, "gff").select("line_no", is_element_type(F.col("type")).alias("is_element")),
        "generated_id": lambda s, d: lens.view(s, d, "te2").select("line_no", generated_id(F.col("line_no"), F.col("te_start"), F.col("te_end")).alias("id")),
        "format_sniff": _sniffed,
        "report_rows": lambda s, d: report_rows(unique(gff3(lens.gff3_lines(s, d)), _blocks(s, d, 1)), "line_no"),
        "report_order": lambda s, d: numbered(report_rows(unique(gff3(lens.gff3_lines(s, d)), _blocks(s, d, 1)), "line_no"), width=1 << 12),
        "format_by_ending": _endings,
        "argument_cases": _commands,
        "console_summary": _console,
        "te_preview": lambda s, d: _previewed(element_preview(gff3(lens.gff3_lines(s, d)))),
        "synteny_preview": lambda s, d: _previewed(synteny_preview(_syn_parsed(s, d))),
    }


def _values(row: tuple) -> str:
    return ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" for x in row)


def oracle_sql() -> dict[str, str]:
    ctes = lens.ctes()
    rows = lens.NOT_ROWS
    tests = " OR ".join(f"contains(type, '{x}')" for x in ELEMENT_TYPES)
    te = ", ".join(_TE)
    with_ = lambda body, more="": f"WITH {ctes}{more} {body}"
    hit = lambda g, rel="t": f"EXISTS (SELECT 1 FROM syn b WHERE b.chr{g} = {rel}.chr AND b.start{g} <= {rel}.te_end AND b.end{g} >= {rel}.te_start)"
    uni = lambda g, cols=te: f"SELECT {cols} FROM te{g} t WHERE NOT {hit(g)}"
    both = f"SELECT 1 AS genome, * FROM ({uni(1)}) UNION ALL SELECT 2 AS genome, * FROM ({uni(2)})"
    made = "'TE_' || line_no || '_' || te_start || '_' || te_end"
    gff = f", g AS (SELECT line_no, coalesce(own_id, {made}) AS id, chr, te_start, te_end, strand, type, family, coalesce(own_name, own_id, {made}) AS name FROM gff WHERE NOT {rows} AND ({tests}))"
    bedded = f"NOT {rows} AND key % 19 <> 0"
    made_bed = "'TE_' || line_no || '_' || (te_start + 1) || '_' || te_end"
    bed_cols = {
        "line_no": "line_no",
        "id": made_bed,
        "chr": "chr",
        "te_start": "CAST(te_start + 1 AS INT)",
        "te_end": "te_end",
        "strand": "CASE WHEN key % 5 + 3 > 5 THEN strand ELSE '.' END",
        "type": "CASE WHEN key % 5 + 3 > 6 THEN type ELSE 'transposable_element' END",
        "family": "CAST(NULL AS STRING)",
        "name": f"CASE WHEN key % 5 + 3 > 3 THEN 'n' || key ELSE {made_bed} END",
    }
    bed_sql = lambda *cols: with_(f"SELECT {', '.join(f'{bed_cols[c]} AS {c}' for c in cols)} FROM gff WHERE {bedded}")
    syn_rows = rows.replace("key", "line_no")
    syn_sql = lambda cols, more="": with_(f"SELECT {cols} FROM syn WHERE NOT {syn_rows}{more}")
    seen = lambda key: with_(f"SELECT coalesce({key}, 'unknown') AS {key}, count(*) AS n, min(line_no) AS first_seen FROM (SELECT * FROM te2 t WHERE NOT {hit(2)}) GROUP BY 1")
    count = lambda key: with_(f"SELECT genome, coalesce({key}, 'unknown') AS {key}, count(*) AS n FROM ({both}) GROUP BY 1, 2")
    blank = r"[\x20\x09-\x0D]*"
    number = lambda pattern, kind, zero: f"SELECT o_orderkey AS k, coalesce(try_cast(regexp_extract({_TEXT}, '^{blank}({pattern})', 1) AS {kind}), {zero}) AS v FROM orders"
    edges = ", ".join(str(e) for e in _EDGES)
    whole = "key % 7 = 0"
    n = "key % 5 + 3"
    bed_fields = f"chr || '|' || te_start || '|' || te_end || CASE WHEN {n} > 3 THEN '|n' || key ELSE '' END || CASE WHEN {n} > 4 THEN '|100' ELSE '' END || CASE WHEN {n} > 5 THEN '|' || strand ELSE '' END || CASE WHEN {n} > 6 THEN '|' || type ELSE '' END"
    # A comment's first field carries its mark, which stands before a doubled tab's empty field.
    mark = f"CASE WHEN key % {lens.COMMENT} = 0 THEN CASE WHEN {whole} THEN '#|' ELSE '#' END ELSE '' END"
    tokenised = f"SELECT line_no, CASE WHEN key % 19 = 0 THEN 'track name=x|y|z' WHEN key % {lens.COMMENT} <> 0 AND key % {lens.SHORT} = 0 THEN chr || '|' || te_start ELSE {mark} || {bed_fields} END AS fields FROM gff"
    # Raw tabs of a line: those behind fields, a leading one, and those behind a carriage return.
    doubled = f"CASE WHEN {whole} THEN 2 ELSE 1 END"
    bed_tabs = f"CASE WHEN key % 19 = 0 THEN 2 WHEN key % {lens.SHORT} = 0 THEN {doubled} ELSE least({n}, 6) * {doubled} + {doubled} - 1 + CASE WHEN key % {lens.RETURN} = 0 THEN 2 ELSE 0 END END"
    counts = "(SELECT count(*) FROM te1) AS te1, (SELECT count(*) FROM te2) AS te2, (SELECT count(*) FROM syn) AS synteny"
    summed = with_(
        "SELECT *, CASE WHEN te1 > 0 THEN CAST(100 AS DOUBLE) * unique1 / te1 ELSE CAST(0 AS DOUBLE) END AS pct1, CASE WHEN te2 > 0 THEN CAST(100 AS DOUBLE) * unique2 / te2 ELSE CAST(0 AS DOUBLE) END AS pct2, unique1 + unique2 AS total_unique "
        f"FROM (SELECT {counts}, (SELECT count(*) FROM ({uni(1)})) AS unique1, (SELECT count(*) FROM ({uni(2)})) AS unique2)"
    )
    share = lambda g: f"'Genome {g} unique transposons: ' || unique{g} || ' (' || printf('%.1f', pct{g}) || '% of total)'"
    console = ["'Genome 1: ' || te1 || ' transposons'", "'Genome 2: ' || te2 || ' transposons'", "'Synteny blocks: ' || synteny", "''", "'=== TE Difference Analysis Results ==='", share(1), share(2)]
    reported = "id || chr(9) || chr || chr(9) || te_start || chr(9) || te_end || chr(9) || strand || chr(9) || type || chr(9) || coalesce(family, 'N/A') || chr(9) || name"
    return {
        "unique_all": with_(both),
        "unique_genome1": with_(uni(1)),
        "unique_genome2": with_(uni(2)),
        "in_synteny_genome1": with_(f"SELECT {te} FROM te1 t WHERE {hit(1)}"),
        "in_synteny_genome2": with_(f"SELECT {te} FROM te2 t WHERE {hit(2)}"),
        "unique_broadcast_genome2": with_(uni(2)),
        "unique_sweep_genome1": with_(uni(1)),
        "unique_sweep_genome2": with_(uni(2)),
        "unique_binned_genome1": with_(uni(1)),
        "unique_no_synteny": with_(f"SELECT {te} FROM te1"),
        "unique_other_side": with_(f"SELECT {te} FROM te1"),
        "overlap_edge_cases": f"SELECT k, bs <= e AND be >= s AS hit FROM (VALUES {edges}) AS v(k, s, e, bs, be)",
        "type_counts": count("type"),
        "family_counts": count("family"),
        "type_counts_first_seen": seen("type"),
        "family_counts_first_seen": seen("family"),
        "unique_summary": summed,
        "relation_counts": with_("SELECT 'te1' AS relation, count(*) AS n FROM te1 UNION ALL SELECT 'te2', count(*) FROM te2 UNION ALL SELECT 'synteny', count(*) FROM syn"),
        "synteny_parse": syn_sql("line_no, chr1, start1, end1, chr2, start2, end2, score"),
        "synteny_normalised": syn_sql("line_no, start1, end1, start2, end2"),
        "synteny_default_score": syn_sql("line_no, score", " AND score = 1"),
        "gff3_parse": with_("SELECT * FROM g", gff),
        "gff3_type_filter": with_("SELECT type, count(*) AS n FROM g GROUP BY type", gff),
        "gff3_attributes": with_(f"SELECT line_no, own_id, own_name, family FROM gff WHERE NOT {rows}"),
        "gff3_generated_ids": with_("SELECT line_no, id, name FROM g WHERE starts_with(id, 'TE_')", gff),
        "bed_parse": bed_sql(*bed_cols),
        "bed_arity_defaults": bed_sql("line_no", "strand", "type", "name"),
        "bed_generated_ids": bed_sql("line_no", "id"),
        "line_filter": with_(f"SELECT line_no FROM gff WHERE key % {lens.COMMENT} <> 0 AND key % 19 <> 0"),
        "arity_rejects": with_(
            f"SELECT line_no, 8 AS n_tokens, 'gff3' AS form FROM gff WHERE key % {lens.COMMENT} <> 0 AND key % {lens.SHORT} = 0 UNION ALL "
            f"SELECT line_no, 5 AS n_tokens, 'synteny' AS form FROM syn WHERE line_no % {lens.COMMENT} <> 0 AND line_no % {lens.SHORT} = 0 UNION ALL "
            f"SELECT line_no, 2 AS n_tokens, 'bed' AS form FROM gff WHERE key % 19 <> 0 AND key % {lens.COMMENT} <> 0 AND key % {lens.SHORT} = 0"
        ),
        "tokenise_collapse": with_(tokenised),
        "c_int_coercion": number("[+-]?[0-9]+", "INT", "0"),
        "c_float_coercion": number(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", "DOUBLE", "CAST(0 AS DOUBLE)"),
        "element_type_substring": with_(f"SELECT line_no, ({tests}) AS is_element FROM gff"),
        "generated_id": with_(f"SELECT line_no, {made} AS id FROM te2"),
        "format_sniff": with_(
            f"SELECT 'gff3' AS kind, line_no, CASE WHEN key % {lens.SHORT} = 0 AND NOT {whole} THEN 'bed' ELSE 'gff3' END AS form FROM gff WHERE line_no <= {SNIFFED_LINES} AND key % {lens.COMMENT} <> 0 UNION ALL "
            f"SELECT 'bed', line_no, CASE WHEN {bed_tabs} >= {GFF3_TABS} THEN 'gff3' WHEN {bed_tabs} >= {BED_TABS} THEN 'bed' END FROM gff WHERE line_no <= {SNIFFED_LINES} AND (key % {lens.COMMENT} <> 0 OR key % 19 = 0)"
        ),
        "report_order": with_(f"SELECT row_number() OVER (ORDER BY line_no) AS n, line_no, {reported} AS row FROM g t WHERE NOT {hit(1)}", gff),
        "format_by_ending": f"SELECT k, CASE lower(regexp_extract(name, '[.][^.]*$')) WHEN '.gff3' THEN 'gff3' WHEN '.gff' THEN 'gff3' WHEN '.bed' THEN 'bed' END AS form FROM (SELECT p_partkey AS k, {_NAME} AS name FROM part)",
        "argument_cases": f"SELECT * FROM (VALUES {', '.join(f'({_values((line, *told))})' for line, told in _COMMANDS)}) AS v(line, {', '.join(c.split()[0] for c in _ARGUMENTS.split(', '))})",
        "console_summary": f"WITH s AS ({summed}) " + " UNION ALL ".join(f"SELECT {k} AS n, {text} AS line FROM s" for k, text in enumerate(console, 1)),
        "report_rows": with_(f"SELECT line_no, {reported} AS row FROM g t WHERE NOT {hit(1)}", gff),
        "te_preview": with_(f"SELECT id, chr, te_start, te_end, strand, type, coalesce(family, 'N/A') AS family FROM g ORDER BY line_no LIMIT {ELEMENT_ROWS}", gff),
        "synteny_preview": with_(f"SELECT chr1, start1, end1, chr2, start2, end2, score FROM syn WHERE NOT {syn_rows} ORDER BY line_no LIMIT {SYNTENY_ROWS}"),
    }
