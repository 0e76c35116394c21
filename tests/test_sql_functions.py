"""The session's SQL functions agree with the column functions."""

from pyspark.sql import functions as F

from lacuna.functions import c_float, c_int, cut_line, gff_attribute, overlaps, tokens
from lacuna.functions.sql import register


def test_functions(spark):
    register(spark)
    texts = ["12abc", "abc", " +7", "-3.5e1x", "", ".5", "99999999999", "ID=a; ID=b=c;Name=", "\tx\t\ty\rz", "ID"]
    df = spark.createDataFrame([(t, i, i + 3, 4, 6) for i, t in enumerate(texts)], "t string, s int, e int, bs int, be int")
    df.createOrReplaceTempView("odd")
    sql = spark.sql("SELECT c_int(t), c_float(t), tab_tokens(t), gff_attribute(t, 'ID'), intervals_overlap(s, e, bs, be) FROM odd ORDER BY s").collect()
    t = F.col("t")
    own = df.orderBy("s").select(c_int(t), c_float(t), tokens(cut_line(t), 99), gff_attribute(t, "ID"), overlaps(F.col("s"), F.col("e"), F.col("bs"), F.col("be"))).collect()
    assert [tuple(r) for r in sql] == [tuple(r) for r in own]
