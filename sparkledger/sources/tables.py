"""Readers that fail on an unexpected shape, and writers that never overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored

PARTITIONS = ["train", "tuning", "calibration", "test"]


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_transactions(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Text columns of one registered CSV dialect; the header must have exactly these columns in this order.

    Rows carry their file and row_no, their number in it from 1. Numbers inside a block come from the order of the scan, and
    blocks are counted first, so no task reads a whole file."""
    found = spark.read.option("header", True).csv(path).columns
    if found != header:
        raise ValueError(f"the header is {found}, not {header}")
    d = spark.read.schema(text_schema(header)).option("header", True).option("enforceSchema", False).csv(path)
    d = d.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))
    blocks = d.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "first", before.alias("before"))
    return d.join(starts, ["file", "block"]).select(*header, "file", (F.col("before") + F.col("number") - F.col("first") + 1).alias("row_no"))


def read_reference_csv(spark: SparkSession, path: str, required: list[str], allowed: list[str]) -> DataFrame:
    """Rows as text with malformed, true for rows of too many or too few cells; required columns must be there."""
    found = [c.lstrip("﻿") for c in spark.read.option("header", True).csv(path).columns]
    if set(required) - set(found) or set(found) - set(allowed):
        raise ValueError(f"missing {sorted(set(required) - set(found))}, unknown {sorted(set(found) - set(allowed))}")
    schema = text_schema([*found, "_corrupt"])
    d = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return d.withColumn("malformed", F.col("_corrupt").isNotNull()).drop("_corrupt")


def read_sms_backup(spark: SparkSession, path: str) -> DataFrame:
    """(address, body, type, sent_at) of an XML message backup; the declared count must equal the rows."""
    attributes = ["_address", "_body", "_type", "_date"]
    d = spark.read.schema(text_schema(attributes)).format("xml").option("rowTag", "sms").load(path)
    declared = spark.read.schema("_count long").format("xml").option("rowTag", "smses").load(path).agg(F.sum("_count")).first()[0]
    if declared != (n := d.count()):
        raise ValueError(f"{declared} messages are declared, {n} found")
    sent = F.timestamp_millis(F.col("_date").cast("long"))
    return d.select(F.col("_address").alias("address"), F.col("_body").alias("body"), F.col("_type").alias("type"), sent.alias("sent_at"))


# The version, the fields and the enumerations of a withdrawal ledger.
LEDGER_VERSION = "withdrawal-ledger-v1"
LEDGER_FIELDS = ["participant_id_hash", "withdrawn_at", "scope", "status", "request_reference"]
LEDGER_SCOPES = ["all_research_data_and_derivatives", "future_processing_only", "public_release_only"]
LEDGER_STATUSES = ["pending_disable", "pending_deletion", "pending_rebuild", "completed"]
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def read_withdrawal_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(participant_id_hash, withdrawn_at, scope, status, request_reference) of a ledger, as text.

    Another version, an entry with other fields than these, a hash that is no sha256 in lower-case hexadecimal, a time not in
    ISO form, an unknown scope or status, an empty reference or a repeated participant is an error that names what was found."""
    d = spark.read.schema("schema_version string, entries array<map<string, string>>").option("multiLine", True).json(path)
    odd = d.where(~F.col("schema_version").eqNullSafe(LEDGER_VERSION) | F.col("entries").isNull()).agg(F.count("*"), F.max("schema_version")).first()
    if odd[0]:
        raise ValueError(f"not a list of entries of {LEDGER_VERSION}: {odd[1]}")
    e = d.select(F.explode("entries").alias("e"))
    at = {c: F.coalesce(F.col("e")[c], F.lit("")) for c in LEDGER_FIELDS}
    rules = {
        "fields": ~F.array_sort(F.map_keys("e")).eqNullSafe(F.array(*map(F.lit, sorted(LEDGER_FIELDS)))),
        "participant_id_hash": ~at["participant_id_hash"].rlike("^[0-9a-f]{64}$"),
        "withdrawn_at": ~at["withdrawn_at"].rlike(ISO_TIME) | at["withdrawn_at"].try_cast("timestamp").isNull(),
        "scope": ~at["scope"].isin(LEDGER_SCOPES),
        "status": ~at["status"].isin(LEDGER_STATUSES),
        "request_reference": F.trim(at["request_reference"]) == "",
    }
    # One pass over the entries: how many break each rule, and how many participants are there more than once.
    by = e.groupBy(at["participant_id_hash"].alias("p")).agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(r, F.lit(True))).alias(k) for k, r in rules.items()))
    found = by.agg(*(F.sum(k).alias(k) for k in rules), F.count_if(F.col("n") > 1).alias("participant twice")).first().asDict()
    if broken := {k: n for k, n in found.items() if n}:
        raise ValueError(f"entries that break a rule: {broken}")
    return e.select(*(F.col("e")[c].alias(c) for c in LEDGER_FIELDS))


CURRENT = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(conf)


def published(spark: SparkSession, root: str) -> str:
    """The folder of the generation that root's pointer names."""
    _, at, fs = _fs(spark, f"{root}/{CURRENT}")
    if not fs.exists(at):
        raise FileNotFoundError(f"nothing is published in {root}")
    name = spark.read.text(f"{root}/{CURRENT}").first()[0]
    return f"{root}/{name}"


def publish_all(datasets: dict[str, DataFrame], root: str, key: str | None = None, partition_by: list[str] | None = None, shard_rows: int | None = None) -> str:
    """Write datasets as one generation of root and make it the published one; returns its folder.

    Each dataset is written under a new generation, read again and compared with what was to be written: its rows, and those of
    the others, by count, xor and sum of the hashes of the key (of all columns without a key). Only then a pointer file is
    renamed into place, which is refused where one is there: readers see all of it or nothing, whenever a writer dies. What
    a dead writer leaves is a generation that nothing points to."""
    spark = next(iter(datasets.values())).sparkSession
    jvm, pointer, fs = _fs(spark, f"{root}/{CURRENT}")
    if fs.exists(pointer):
        raise FileExistsError(f"{root} is published already")
    generation = f"generation-{uuid.uuid4().hex}"
    want = None
    for name, df in datasets.items():
        writer = df.write.mode("errorifexists")
        writer = writer.option("maxRecordsPerFile", shard_rows) if shard_rows else writer
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{generation}/{name}")
        columns = [key] if key else df.columns
        found = content_fingerprint(spark.read.schema(df.schema).parquet(f"{root}/{generation}/{name}"), columns).first()
        want = want if key and want else content_fingerprint(df, columns).first()
        if found != want:
            raise ValueError(f"{name} was not written as it should: {found}, not {want}")
    staged = jvm.org.apache.hadoop.fs.Path(f"{root}/{generation}/pointer")
    out = fs.create(staged, False)
    out.write(bytearray(generation.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(staged, pointer, options)
    return f"{root}/{generation}"


def write_feature_dataset(df: DataFrame, root: str, features: list[str], label: str, provenance: list[str], key: str = "source_row_id", shard_rows: int = 100_000) -> str:
    """Features, labels and provenance as three datasets of one generation (publish_all), by partition; the key in each aligns
    them, not file order. The plan of df runs once: its rows are stored in the shared folder first."""
    parts = (("features", features), ("labels", [label]), ("provenance", provenance))
    df = stored(df.select("partition", *dict.fromkeys([key, *(c for _, columns in parts for c in columns)])))
    out = {name: df.select("partition", key, *(c for c in columns if c != key)) for name, columns in parts}
    return publish_all(out, root, key, ["partition"], shard_rows)


def load_partition(spark: SparkSession, root: str, name: str, columns: list[str] | None = None, dataset: str = "features") -> DataFrame:
    """One partition (pruned to its folder) of a dataset of the published generation; the sealed test partition is refused, the
    column order checked."""
    if name not in PARTITIONS or name == "test":
        raise PermissionError(f"partition {name} is not open")
    d = spark.read.parquet(f"{published(spark, root)}/{dataset}").where(F.col("partition") == name).drop("partition")
    if columns is not None and d.columns != columns:
        raise ValueError(f"the columns are {d.columns}, not {columns}")
    return d


def csv_safe(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would read as formulas get a leading quote."""
    text = [k for k, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(F.col(c).rlike("^[=+@-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c in text})


def write_csv_safe(df: DataFrame, path: str) -> None:
    csv_safe(df).write.mode("errorifexists").option("header", True).csv(path)


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that tells a dataset's rows apart from others, in any order: count, xor and sum of row hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("s"))


def publish(df: DataFrame, path: str) -> str:
    """Write once: one dataset, rows, as a generation of path; a path that is published already is an error."""
    return publish_all({"rows": df}, path)


def read_published(spark: SparkSession, path: str, dataset: str = "rows") -> DataFrame:
    return spark.read.parquet(f"{published(spark, path)}/{dataset}")
