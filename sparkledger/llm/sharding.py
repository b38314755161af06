"""Sharding over fixed virtual slots.

Records are hashed into thousands of slots. The bytes of each slot are summed, and a slot-to-shard map, of as many
rows as there are slots, says where each goes. Maps are stored by version and never changed: a rebalance reads one
version, moves the fewest slots it can from heavy shards to light ones, and stores the next.

A record's slot is a hash of its id, its text's checksum and its number among the rows that equal it, and never changes:
only an edit of the map moves rows, and more copies of a row leave the slots of the earlier ones as they are. Which of
equal rows has which number makes no difference, so that they are counted first and numbered from the count. Equal texts
with different ids are different records.

A row's place in its shard is the count of rows in the shard's earlier slots plus its number within its slot, so no
shard is ever gathered in one task.

Defined results: a null text has no bytes and checksum 0; a null doc_id is hashed like any other; repeated rows each
get their own slot and place; texts of any length are read where they lie; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise

SLOTS = 4096
OVERHEAD = 8
#: Equal rows that one task numbers; more are numbered in parts.
COPIES = 1 << 16
_MAP = "virtual_slot int, shard int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot) for each row; copy numbers equal rows from 0. Written once on the way."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counts = materialise(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")))
    many = counts.where(F.col("n") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    parts = counts.where(F.col("n") <= COPIES).withColumn("part", F.lit(0).cast("long")).unionByName(many.repartition("doc_id", "text_crc32", "part"))
    first = F.col("part") * COPIES
    copy = F.explode(F.sequence(first, F.least(F.col("n"), first + COPIES) - 1)).alias("copy")
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int")
    return parts.select("doc_id", "size", "text_crc32", copy).withColumn("virtual_slot", slot)


def slot_loads(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, n): one row for each slot in use."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def even_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The map before any bytes are known: slots in turn."""
    return {slot: slot % shards for slot in range(slots)}


def shard_documents(docs: DataFrame, shards: int, folder: str, slots: int = SLOTS, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) for each row. The latest map of the folder, or the even map as
    version 1 of a new one, is rebalanced by the bytes of these rows, and the edit is stored as the next version."""
    spark, rows = docs.sparkSession, records(docs, slots)
    loads = materialise(slot_loads(rows))
    held = {r["virtual_slot"]: r["bytes"] for r in loads.collect()}
    version = latest_version(spark, folder)
    if version == 0:
        version = 1
        store_map(spark, even_map(shards, slots), folder, 1)
    old = {r["virtual_slot"]: r["shard"] for r in load_map(spark, folder, version).collect()}
    new = rebalanced(old, held, shards, tolerance)
    if new != old:
        version += 1
        store_map(spark, new, folder, version)
    return assign(rows.drop("copy"), load_map(spark, folder, version), loads)


def rebalanced(old: dict[int, int], loads: dict[int, int], shards: int, tolerance: float = 0.001) -> dict[int, int]:
    """An edit of old: slots leave shards above the mean (or beyond the last shard) for the lightest, largest first,
    until every shard is within tolerance of the mean or no move helps."""
    out, mean = dict(old), sum(loads.values()) / shards
    size = dict.fromkeys(range(shards), 0)
    homeless = sorted((s for s, k in out.items() if k >= shards), key=lambda s: (-loads.get(s, 0), s))
    for slot, shard in out.items():
        if shard < shards:
            size[shard] += loads.get(slot, 0)
    for slot in homeless:
        out[slot] = min(size, key=lambda k: (size[k], k))
        size[out[slot]] += loads.get(slot, 0)
    inside: dict[int, list[int]] = {k: [] for k in range(shards)}
    for slot, shard in out.items():
        inside[shard].append(slot)
    while True:
        heavy, light = max(size, key=lambda k: (size[k], -k)), min(size, key=lambda k: (size[k], k))
        gap = size[heavy] - size[light]
        fits = [s for s in inside[heavy] if 0 < loads.get(s, 0) < gap]
        if not fits or max(size[heavy] - mean, mean - size[light]) <= tolerance * mean:
            return out
        slot = min(fits, key=lambda s: (abs(gap / 2 - loads.get(s, 0)), s))
        out[slot] = light
        inside[heavy].remove(slot)
        inside[light].append(slot)
        size[heavy] -= loads.get(slot, 0)
        size[light] += loads.get(slot, 0)


def store_map(spark: SparkSession, slot_map: dict[int, int], folder: str, version: int) -> None:
    """Write a version of the map; an existing version is an error."""
    rows = sorted(slot_map.items())
    spark.createDataFrame(rows, _MAP).coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP).parquet(f"{folder}/version={version}")


def latest_version(spark: SparkSession, folder: str) -> int:
    """The number of the latest stored map, 0 if there is none. Versions are written in order, so the first gap ends them."""
    version, conf = 0, spark.sparkContext._jsc.hadoopConfiguration()
    while True:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={version + 1}")
        if not at.getFileSystem(conf).exists(at):
            return version
        version += 1


def assign(rows: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """rows with shard and slot, the row's place in its shard from 0. Both tables have a row for each slot at most."""
    in_order = Window.partitionBy("shard").orderBy("virtual_slot")
    starts = slot_map.join(loads.select("virtual_slot", "n"), "virtual_slot").select(
        "virtual_slot", "shard", (F.sum("n").over(in_order) - F.col("n")).alias("start")
    )
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(in_slot) - 1)
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("number")).drop("start", "number")
