"""Column functions on texts that Spark has no built-in for: compatibility forms, sequence similarity and edits of sequences.

They go to Arrow UDFs only where a built-in cannot settle the value; settled rows send a null to Python.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return texts
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.DoubleType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in pairs], pa.float64())


def _distance(a: str | list[str], b: str | list[str], block: int = 1 << 12) -> int:
    """The least number of edits from a to b (Myers' bit vectors): a column of the table of edits is two whole numbers.

    The longer side is taken a block of rows at a time, so that memory grows with the length; turns are the steps along a
    block's edge."""
    a, b = (b, a) if len(a) < len(b) else (a, b)
    turns = [1] * len(b)
    for start in range(0, len(a), block):
        part = a[start : start + block]
        at = {}
        for i, x in enumerate(part):
            at[x] = at.get(x, 0) | 1 << i
        last = 1 << len(part) - 1
        full = 2 * last - 1
        plus, minus = full, 0
        for j, y in enumerate(b):
            same, turn = at.get(y, 0), turns[j]
            down = same | minus
            if turn < 0:
                same |= 1
            across = ((same & plus) + plus ^ plus) | same
            up, low = (minus | ~(across | plus)) & full, plus & across
            turns[j] = 1 if up & last else -1 if low & last else 0
            up, low = up << 1 | (turn > 0), low << 1 | (turn < 0)
            plus, minus = (low | ~(down | up)) & full, up & down & full
    return len(a) + sum(turns) if a else 0


@F.arrow_udf(T.LongType())
def _edits(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else _distance(x, y) for x, y in pairs], pa.int64())


#: The bytes of a text in upper case that are no letter, digit, space or line end of ASCII; all those of other characters.
_OTHERS = bytes(k for k in range(256) if not (k < 128 and (chr(k).isupper() or chr(k).isdigit() or chr(k) in " \n")))


def _lines(texts: pa.Array, drop: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row, the place in its text and the bytes of each line, without those to drop; a null has no line."""
    rows, texts = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)), texts.drop_null()
    if not len(rows):
        return rows, rows, pa.array([], pa.binary())
    counts = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_py().encode()
    starts = np.cumsum(counts) - counts
    return np.repeat(rows, counts), np.arange(counts.sum()) - np.repeat(starts, counts), pc.list_flatten(pc.split_pattern(pa.array([whole.translate(None, drop)], pa.binary()), b"\n"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _piece_means(words: pa.Array, numbers: pa.Array, values: pa.Array) -> pa.Array:
    row, place, word = _lines(words, _OTHERS + b" ")
    value_row, _, value = _lines(values, _OTHERS)
    parts = pc.split_pattern(value, b" ")
    line, piece = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False), pc.list_flatten(parts)
    codes = pa.concat_arrays([word, piece]).dictionary_encode()
    n, code = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # A word is heard if it has a number; a piece is asked for in a row, once in each line.
    ends, flat = numbers.offsets.to_numpy(), numbers.values
    have = place < np.diff(ends)[row]
    at = (ends[:-1][row] + place)[have]
    key, number = (row * n + code[: len(word)])[have], flat.fill_null(0.0).to_numpy(zero_copy_only=False)[at]
    if flat.null_count:
        known = flat.is_valid().to_numpy(zero_copy_only=False)[at]
        key, number = key[known], number[known]
    line, asked = np.divmod(np.unique((line * n + code[len(word) :])[pc.binary_length(piece).to_numpy(zero_copy_only=False) > 0]), max(n, 1))
    wanted, which = np.unique(value_row[line] * n + asked, return_inverse=True)
    total = count = np.zeros(len(value))
    if len(wanted):
        near = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        hit = wanted[near] == key
        sums, counts = np.bincount(near[hit], number[hit], len(wanted)), np.bincount(near[hit], minlength=len(wanted))
        total, count = np.bincount(line, sums[which], len(value)), np.bincount(line, counts[which], len(value))
    means = pa.array(total / np.maximum(count, 1), mask=count == 0)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(value_row, np.arange(len(values) + 1)), pa.int32()), means)


def piece_means(words: Column, numbers: Column, values: Column) -> Column:
    """For each line of values the mean number of the words that spell one of its pieces, null where there is none; no line where values is null.

    words is a text of a word a line, and numbers an array in the same order; both texts are in upper case. A word, or a piece
    between spaces, is spelt by its letters and digits. Built-in functions would take each word of each array one by one
    outside compiled code, and far longer."""
    return _piece_means(words, numbers, values)


def edits(a: Column, b: Column) -> Column:
    """The Levenshtein distance of two texts by code points, or of two arrays of texts by elements; null where a side is null.

    F.levenshtein takes texts only, and each cell of its table by itself. Equal sides are not sent to Python."""
    differ = a != b
    return F.when(differ, _edits(F.when(differ, a), F.when(differ, b))).when(a.isNotNull() & b.isNotNull(), F.lit(0))


def nfkc(text: Column) -> Column:
    """The NFKC form; null stays null. ASCII is its own form and is never sent to Python."""
    other = F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)


def clean_text(text: Column) -> Column:
    """The NFKC form with runs of white space as one space, and none at the ends."""
    return F.trim(F.regexp_replace(nfkc(text), r"(?U)\s+", " "))


def sequence_ratio(a: Column, b: Column) -> Column:
    """The Ratcliff/Obershelp ratio of two texts, a first: twice the matched characters over all; null where a side is null.

    Equal texts have ratio 1 and are not sent to Python."""
    differ = a != b
    return F.when(differ, _ratio(F.when(differ, a), F.when(differ, b))).when(a.isNotNull() & b.isNotNull(), F.lit(1.0))


def sequence_similar(a: Column, b: Column, least: float) -> Column:
    """Whether sequence_ratio(a, b) is at least that. Only different texts whose lengths allow it are sent to Python."""
    room = 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)) >= least
    open_ = (a != b) & room
    return F.when(open_, _ratio(F.when(open_, a), F.when(open_, b)) >= least).otherwise(a == b)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """One less the edits over the longer length: the built-in likeness of two texts, which is not sequence_ratio."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
