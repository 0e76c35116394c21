"""What the operators of this package share: reading tables, the shared folder, the word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader, so that any file system will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Parts (of spark.sql.files.maxPartitionBytes at most) up to which a table is dealt out anew.
FEW_PARTS = 8


def spread(df: DataFrame) -> DataFrame:
    """A table of a few files over all cores.  This is layout alone: larger tables stay as they come,
    and are never shuffled here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < min(cores, FEW_PARTS + 1) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset and all runs on one machine, as in tests, a temporary folder is made once
    for the session; a cluster without it is an error.
    """
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set(key, base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here and losing an
    executor afterwards costs nothing that was already computed."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that no result reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._settled_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that may hold more than one in ``HEAVY`` of all rows are fewer than this.
HEAVY = 1000


def join_by_size(left: DataFrame, right: DataFrame, keys: list[str], size: str, rows: int) -> DataFrame:
    """``left`` (of ``rows`` rows) with the columns of ``right``, which has a row per key (never null)
    and in ``size`` how many rows of ``left`` have it.

    Keys with more than one in ``HEAVY`` rows are fewer than ``HEAVY``, so that part of ``right`` is
    broadcast whatever the input's size, and their rows are not shuffled; the others are joined by
    a shuffle, in which no key is larger than that share.
    """
    heavy = F.col(size) * HEAVY > rows
    few = right.filter(heavy)
    many = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.filter(~heavy), keys)
    return many.unionByName(left.join(F.broadcast(few), keys))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text (none for null), as an array, without user functions."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda Catalyst would evaluate an outer expression again for every element; as the
    variable of a one-element transform it is computed a single time.
    """
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on, and the next
    stage's tasks, in this process and others, need the room."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there only with the GNU C library
    if trim:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    import os
    import zipfile
    from pathlib import Path

    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_lacuna_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lacuna-"), "lacuna.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    context._lacuna_shipped = True
