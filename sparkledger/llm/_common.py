"""Shared helpers: row identity, lineage cuts in the cluster's shared folder, ASCII lower case."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters that the contracts name: x20 and x09-x0D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent the session is a local one, as in tests, and a temporary folder serves.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: list[str] = []


def tables() -> list[str]:
    """The tables written by materialise() that were not discarded, oldest first."""
    return list(_written)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no DataFrame in use reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _written.remove(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the session's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later stages survive lost executors.

    What was not discarded by then is deleted when the session's JVM ends."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Where a text has only ASCII and the small letters of Latin-1, lower() does that, and faster."""
    same = ~F.regexp_like(c, F.lit(r"[^\x00-\x7F\xDF-\xF6\xF8-\xFF]"))
    return F.when(same, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key() -> Column:
    """A row's identity by doc_id and text, so that null or repeated doc_ids with different texts stay apart."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name made of name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(c: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that the optimizer evaluates once here: it moves no filter below and copies none into a lambda."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
