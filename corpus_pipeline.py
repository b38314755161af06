"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the
shared folder and reads them back for the next, so a lost executor never costs more than the stage at hand. Tables that
only an earlier stage needed are deleted as soon as its result is written.

Every stage takes nulls, repeated rows, empty tables, texts of any length (read whole) and other columns of any name, which
it passes on. Of equal or near texts the row of the smallest doc_id stays; of lines that many documents share, that of the
largest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.llm import decontaminate, line_dedup, quality_rules, simhash_dedup, token_dictionary
from sparkledger.llm._common import discard, free_name, materialise, table, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep."""
    return quality_rules.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines that many documents share; n_chars, if there, follows the text."""
    counts = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out = line_dedup.dedup_lines(docs, counts=counts)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(counts[1]) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return simhash_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no window of the benchmark occurs."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of all rows."""
    return token_dictionary.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("encode", encode),
]

#: Fingerprints and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = tables()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            discard(spark, [*before, *tables()[len(before) : -1]])
    return docs
