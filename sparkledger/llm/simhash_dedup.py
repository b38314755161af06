"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits differ in at most two bytes,
so they share at least six positional bytes: six is the guaranteed minimum of matches. A posting list of one byte would
hold a 256th of the corpus and its pairs would grow with the square, so the postings are compound: the bytes make four
pairs, two differing bytes leave two of the four whole, and there is a list for each two pairs (six lists of 32 bits).
Of the pairs of fingerprints that meet in a list, the shared positional bytes are tallied, those that reach the minimum
are retained, and their bits are verified.

A group of near copies can fill a list, so pairs are spelled out in lists of FEW at most. Members of longer lists post
themselves and their 64 one-bit changes instead; fingerprints that share such a midpoint differ in at most two bits,
and each links to the smallest of them. That gives the same components as all pairs, and is linear in the members.

Exact copies share a fingerprint and are one node. Components come from components.py; no link, component or
fingerprint list goes to the driver.

Defined results: a null text or one without words has fingerprint zero, linked like any other; a null doc_id never
names a component unless all its ids are null; repeated rows each get their own result row; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, free_name, materialise, row_key
from .components import connected_components

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: The least shared positional bytes of two fingerprints within two bits.
LEAST_SHARED = 6
#: The longest list whose pairs are spelled out.
FEW = 8
_BYTES = [0xFF << 8 * p for p in range(8)]
_MASKS = [sum(_BYTES[p] for p in range(8) if p // 2 in pairs) for pairs in combinations(range(4), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    ones, n = np.zeros(64, np.int64), 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, len(words) - k + 1)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(row, doc_id, fp): the fingerprint of each row as a bigint with the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py(), shingle, seed)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(fps, pa.int64())], ["row", "doc_id", "fp"])

    d = docs.select(row_key().alias("row"), "doc_id", "text")
    return d.mapInArrow(run, f"row string, doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def shared_bytes(u: Column, v: Column) -> Column:
    """The tally of positional bytes that two fingerprints share."""
    return sum((F.when(u.bitwiseXOR(v).bitwiseAND(F.lit(_signed(m))) == 0, 1).otherwise(0) for m in _BYTES), F.lit(0))


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v): links that join all different fingerprints of fps (fp) within two bits of one another."""
    lists = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("list"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bytes")) for i, m in enumerate(_MASKS)))
    postings = fps.select("fp", F.explode(lists).alias("p")).select("fp", "p.list", "p.bytes")
    sizes = postings.groupBy("list", "bytes").agg(F.count("*").alias("n"), F.min("fp").alias("v"), F.max("fp").alias("u")).where("n > 1")
    sizes = materialise(sizes)
    of = lambda which: postings.join(sizes.where(which).select("list", "bytes"), ["list", "bytes"])
    short = of(f"n BETWEEN 3 AND {FEW}").groupBy("list", "bytes").agg(F.collect_list("fp").alias("fps"))
    spelled = F.flatten(F.transform("fps", lambda x, i: F.transform(F.slice("fps", F.lit(1), i), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    met = sizes.where("n = 2").select("u", "v").unionByName(short.select(F.explode(spelled).alias("x")).select("x.u", "x.v"))
    near = met.where((shared_bytes(F.col("u"), F.col("v")) >= LEAST_SHARED) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2))
    bits = F.array(*(F.lit(_signed(1 << b)) for b in range(64)))
    dense = of(f"n > {FEW}").select("fp").distinct()
    middles = dense.select("fp", F.explode(F.concat(F.array("fp"), F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b)))).alias("mid"))
    least = middles.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n"), F.max("fp").alias("u"))
    two = least.where("n = 2").select("u", "v")
    more = middles.join(least.where("n > 2").select("mid", "v"), "mid").select(F.col("fp").alias("u"), "v")
    links = near.unionByName(two).unionByName(more).where("u <> v")
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_components(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(row, doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    marks = materialise(fingerprints(docs, shingle, seed))
    nodes = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialise(connected_components(near_links(nodes.select("fp"))))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(names, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("row", "doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies: that of the smallest doc_id (among equal ids, of the smallest key)."""
    row, n = free_name(docs, "row"), free_name(docs, "n")
    found = near_components(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Null ids name no group, so each fingerprint group without ids is told by its fingerprint.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("nameless")]
    kept = found.groupBy(*group).agg(F.min("row").alias(row), F.count("*").alias(n)).select(row, n)
    left = docs.withColumn(row, row_key()).join(kept, row)
    single = left.where(F.col(n) == 1)
    # Only rows that repeat in full, or share their doc_id, can share a key here.
    several = left.where(F.col(n) > 1).dropDuplicates([row])
    return single.unionByName(several).select(docs.columns)
