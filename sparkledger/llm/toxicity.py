"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the character n-grams inside its words (word ends included), present or absent, hashed into
a fixed number of places. The log ratio of a feature's smoothed frequencies in toxic and in other training documents
scales it, shrunk where its standard error is large, so that a rare n-gram keeps its place but not the weight of a
frequent one. All features of the training rows take part. Logistic regression with a square penalty fits the weights
by steps over one row at a time (dual coordinate ascent).

Spark reads, joins and packs the training rows; what comes to the driver is a bounded sample: SAMPLE_ROWS rows and
SAMPLE_FEATURES features in them at most. The model is one array of HASHED weights and is broadcast; every row of the
corpus is scored, over its whole text, in one pass without a shuffle.

Defined results: a null or empty text has no features and gets the score of the intercept; labelled rows without a
toxic mark or without a document are not used; a labelled id that repeats in documents counts once, with the least of
its texts; without rows of both classes the score is the smoothed share of toxic rows; repeated rows each get their
own result row; an empty table gives an empty result; the score reads text only, whole and of any length, so that equal texts
score alike; columns other than doc_id and text are not read. Rows of equal hash are sampled in the order of their ids.

The constants of the fit were chosen by folds of the training rows, without the held-out fold
(tests/llm/choose_toxicity_constants.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: The most labelled rows that a model is fitted on (those of smallest hash), and the most features in them together.
SAMPLE_ROWS = 20_000
SAMPLE_FEATURES = 60_000_000
#: Places that the n-grams are hashed to.
HASHED = 1 << 22
SIZES = (3, 4, 5)
#: Standard errors at which half of a ratio's square remains, the weight of a row's loss, and the passes over the rows.
SHRINK = 3.0
LOSS = 3.0
PASSES = 8
THRESHOLD = 0.3

_ALPHANUMERIC = np.array([chr(b).isalnum() for b in range(128)])
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    intercept: float
    weights: np.ndarray | None = None


def grams(text: str | None) -> np.ndarray:
    """The places of a text's n-grams, each once, in no order. ASCII characters but letters and digits separate words;
    an n-gram has the gap before or after a word, never one inside."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    gap = (codes < 128) & ~_ALPHANUMERIC[np.minimum(codes, 127).astype(np.int64)]
    codes[gap] = 32
    out = []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            break
        inside, h = np.zeros(m, bool), np.full(m, n, np.uint64)
        for j in range(n):
            h = h * _BASE + codes[j : j + m]
            if 0 < j < n - 1:
                inside |= gap[j : j + m]
        h = h[~inside]
        out.append(((h ^ (h >> np.uint64(31))) * _MIX >> np.uint64(42)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Distinct:
    """Keeps the first of equal places; the scratch is reused, so a text costs time in its own length only."""

    def __init__(self):
        self.scratch = np.zeros(HASHED, np.int64)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        order = np.arange(len(places))
        self.scratch[places[::-1]] = order[::-1]
        return places[self.scratch[places] == order]


def held_out() -> Column:
    """The fold that no label is learned from: crc32 of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def ratios(toxic: np.ndarray, other: np.ndarray, p: int, n: int, shrink: float = SHRINK) -> np.ndarray:
    """The log-count ratio of each feature found in toxic of p and other of n rows, shrunk by its standard error.

    The two rows' worth of smoothing are shared out like the classes, so that a feature of no row has no ratio."""
    a = 2 * p / (p + n)
    ratio = np.log((toxic + a) / (p + 2)) - np.log((other + 2 - a) / (n + 2))
    error = 1 / (toxic + a) + 1 / (other + 2 - a)
    square = ratio**2
    return np.where(toxic + other > 0, ratio * (square / (square + shrink**2 * error)) ** 2, 0.0)


def fit_rows(found: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, loss: float = LOSS, passes: int = PASSES) -> Model:
    """Logistic regression over the scaled features. found has the features of all rows in a line, lengths how many each
    row has. The rows are visited in an order that is the same at each fit."""
    p = int(toxic.sum())
    n = len(toxic) - p
    if not p or not n:
        return Model(math.log((p + 1) / (n + 1)))
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    counts = np.zeros((2, HASHED))
    for k, a, b in zip(toxic.tolist(), ends, ends[1:], strict=False):
        counts[1 - k][found[a:b]] += 1  # a row's features differ
    scale = ratios(*counts, p, n)
    w, b, held = np.zeros(HASHED), 0.0, np.full(len(toxic), min(1e-3 * loss, 1e-8))
    sign, order = np.where(toxic > 0, 1.0, -1.0), np.random.default_rng(42)
    norms = [float(np.square(scale[found[ends[i] : ends[i + 1]]]).sum()) + 1 for i in range(len(toxic))]
    for _ in range(passes):
        for i in order.permutation(len(toxic)).tolist():
            x = found[ends[i] : ends[i + 1]]
            v = scale[x]
            slope, old, q = sign[i] * (float(w[x] @ v) + b), held[i], norms[i]
            z = old
            for _ in range(20):  # Newton steps for the row's dual variable, kept inside (0, loss)
                step = (slope + q * (z - old) + math.log(z / (loss - z))) / (q + loss / (z * (loss - z)))
                z = z / 10 if z <= step else loss - (loss - z) / 10 if z - step >= loss else z - step
                if abs(step) < 1e-10 * loss:
                    break
            held[i] = z
            w[x] += sign[i] * (z - old) * v
            b += sign[i] * (z - old)
    return Model(b, (w * scale).astype(np.float32))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, n, found): the packed features of the labelled rows outside the held-out fold, sample_rows at most."""
    marked = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct()
        for batch in batches:
            rows = [distinct(grams(t)).astype(np.uint32) for t in batch["text"].to_pylist()]
            cols = [batch["doc_id"], batch["toxic"], pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "n", "found"])

    return texts.mapInArrow(pack, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, n bigint, found binary")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """A model from the labelled rows outside the held-out fold. The rows come to the driver packed, a part at a time."""
    rows = materialise(sample(docs, labels, sample_rows).withColumn("place", F.xxhash64("doc_id", "toxic")))
    # The sizes of sample_rows rows at most; those of smallest hash stay until the features are sample_features.
    sizes = sorted((r["place"], r["n"]) for r in rows.select("place", "n").collect())
    total, last = 0, None
    for place, n in sizes:
        if total and total + n > sample_features:
            break
        total, last = total + n, place
    if last is None:
        return Model(0.0)
    found, lengths, toxic, at = np.zeros(total, np.uint32), [], [], 0
    for r in rows.where(F.col("place") <= last).orderBy("place", "doc_id").toLocalIterator():
        x = np.frombuffer(bytes(r["found"]), np.uint32)
        found[at : at + len(x)] = x
        at += len(x)
        lengths.append(len(x))
        toxic.append(r["toxic"])
    return fit_rows(found, np.array(lengths, np.int64), np.array(toxic, np.uint8))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, distinct = held.value, Distinct()
        for batch in batches:
            z = np.array([m.intercept + (float(m.weights[distinct(grams(t))].sum(dtype=np.float64)) if m.weights is not None else 0.0) for t in batch["text"].to_pylist()])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
