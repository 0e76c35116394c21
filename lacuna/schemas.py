"""Fixed schemas.  Coordinates are closed and start at 1."""

from __future__ import annotations

from pyspark.sql import types as T

LINES = T.StructType([T.StructField("line_no", T.LongType(), False), T.StructField("value", T.StringType())])
ELEMENT = T.StructType(
    [
        T.StructField("line_no", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("chr", T.StringType(), False),
        T.StructField("te_start", T.LongType(), False),
        T.StructField("te_end", T.LongType(), False),
        T.StructField("strand", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("family", T.StringType()),
        T.StructField("name", T.StringType(), False),
    ]
)
SYNTENY = T.StructType(
    [
        T.StructField("line_no", T.LongType(), False),
        T.StructField("chr1", T.StringType(), False),
        T.StructField("start1", T.LongType(), False),
        T.StructField("end1", T.LongType(), False),
        T.StructField("chr2", T.StringType(), False),
        T.StructField("start2", T.LongType(), False),
        T.StructField("end2", T.LongType(), False),
        T.StructField("score", T.DoubleType(), False),
    ]
)
