"""The text rules and the interval test as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BLANK = r"[\\x20\\x09-\\x0D]*"
FUNCTIONS = {
    "c_int": ("t STRING", "INT", rf"coalesce(try_cast(regexp_extract(t, '^{_BLANK}([+-]?[0-9]+)', 1) AS INT), 0)"),
    "c_float": ("t STRING", "DOUBLE", rf"coalesce(try_cast(regexp_extract(t, '^{_BLANK}([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE), CAST(0 AS DOUBLE))"),
    "tab_tokens": ("line STRING", "ARRAY<STRING>", r"filter(split(substring_index(line, '\r', 1), '\t'), x -> x <> '')"),
    "gff_attribute": ("attributes STRING, name STRING", "STRING", "substring(try_element_at(filter(transform(split(attributes, ';'), x -> ltrim(x)), x -> startswith(x, name || '=')), -1), length(name) + 2)"),
    "intervals_overlap": ("a_start INT, a_end INT, b_start INT, b_end INT", "BOOLEAN", "b_start <= a_end AND b_end >= a_start"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
