"""Line dedup: drop lines that many documents share, except in one of them.

Lines travel as 128-bit hashes with their document and position, never as text. They are range-partitioned by
(hash, salt of the document) and sorted by document and position, so that one pass over the sorted stream sees
each document's first occurrence and each group's keeper; the salt spreads a line that a third of all documents
hold over many tasks. Decisions come back as sparse bitmaps (one 64-bit mask for each run of 64 lines that loses
any), and only those are joined to the texts.

Defined results: a null or empty text is one empty line; rows with a null doc_id count as one document, smaller
than any other; repeated rows each get their own result row; an empty table gives an empty result; columns other
than doc_id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BLANKS, ascii_lower, free_name, materialise, row_key

SALTS = 64


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(row, pos): every line occurrence that is to go."""
    spark = docs.sparkSession
    at = (
        docs.select("doc_id", row_key().alias("row"), F.posexplode(_lines()).alias("pos", "line"))
        .select("doc_id", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
        .where(F.length("line") >= min_chars)
        .select(
            F.unhex(F.md5(ascii_lower(F.col("line")))).alias("hash"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
            "doc_id",
            "row",
            "pos",
        )
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hashes are written once; the sample for the ranges, the sorted stream and the join all read them.
    at = materialise(at)
    ranged = at.repartitionByRange(n, "hash", "salt")
    stream = Window.partitionBy("hash", "salt").orderBy(F.desc_nulls_last("doc_id"), "row", "pos")
    before = F.lag("doc_id").over(stream)
    seen = ranged.select(
        "hash",
        "salt",
        "doc_id",
        F.when((F.row_number().over(stream) == 1) | ~F.col("doc_id").eqNullSafe(before), 1).otherwise(0).alias("first"),
    )
    groups = seen.groupBy("hash", "salt").agg(F.sum("first").alias("n"), F.max("doc_id").alias("last"))
    hot = (
        groups.groupBy("hash")
        .agg(F.sum("n").alias("n"), F.max("last").alias("keeper"), F.collect_list("salt").alias("salts"))
        .where(F.col("n") >= min_docs)
        .select("hash", "keeper", F.explode("salts").alias("salt"))
    )
    return at.join(hot, ["hash", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("row", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(row, bitmap): for each row that loses lines, a sparse bitmap: map of pos div 64 to the mask of lost lines."""
    bit = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    return (
        shared_lines(docs, min_chars, min_docs)
        .distinct()
        .groupBy("row", F.expr("pos DIV 64").cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("mask"))
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("bitmap"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with their text reduced to the kept lines, joined by \\n, and the counts of lines and of dropped lines.

    Of docs' other columns only those named as in counts are replaced; a text that loses nothing stays as it was.
    """
    row, bitmap = free_name(docs, "row"), free_name(docs, "bitmap")
    maps = drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).withColumnsRenamed({"row": row, "bitmap": bitmap})
    joined, mask = docs.withColumn(row, row_key()).join(maps, row, "left"), F.col(bitmap)
    kept = F.filter(
        _lines(),
        lambda line, i: F.coalesce(F.getbit(F.element_at(mask, F.expr("0") + F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 0,
    )
    lost = F.aggregate(F.map_values(mask), F.lit(0).cast("long"), lambda n, m: n + F.bit_count(m))
    has = mask.isNotNull()
    return joined.withColumns(
        {
            counts[0]: F.size(_lines()).cast("long"),
            counts[1]: F.when(has, lost).otherwise(F.lit(0).cast("long")),
            "text": F.when(has, F.array_join(kept, "\n")).otherwise(F.col("text")),
        }
    ).drop(row, bitmap)
