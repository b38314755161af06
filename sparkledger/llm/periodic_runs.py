"""Periodic runs of words: equal minimizers at a period's distance seed runs scale by scale, lag scans take short periods.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(6, 4q) that no neighbouring word extends keeping that period.

Periods above SHORT fall into scales: that of size Q = 2^k has the periods above Q / 2, up to Q. At each scale a gram of
Q words is a minimizer where its hash is the least in some window of Q / 2 neighbouring grams. A run of at least four
periods holds two whole windows one period apart with the same grams, so it has two equal minimizers one period apart;
by Fine and Wilf no equal gram of Q words lies between them, so they are neighbours in the list of that gram's
places. Such pairs, alone, are seeds; equal blocks of 2^k words, the largest first, extend a seed to both sides.
Periods up to SHORT are found by a direct scan of each lag. Every run found is compared word by word.

Texts are dealt with where Spark reads them, without a shuffle; the words of many short texts lie in one array, with a
mark of its own after each text, so that a numpy call serves up to CHUNK_WORDS words or one longer text.

Defined results: a null or empty text has no runs and an empty collapsed text; words are [^\\x20\\x09-\\x0D]+ and
compared as they are; runs come by start, then period; repeated rows each get their own result row; an empty table gives
an empty result; a text of any length is one array of its words, whole; columns of any name pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name

#: The longest period that is scanned for directly; a power of two.
SHORT = 8
LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words of neighbouring texts that share an array, unless one text has more.
CHUNK_WORDS = 1 << 19

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _A) ^ (b + _B + (a >> np.uint64(32)))
    x = (x ^ (x >> np.uint64(29))) * _B
    return (x ^ (x >> np.uint64(32))) * _A


def _extreme(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of over each window of width (a power of two) neighbours."""
    step = 1
    while step < width:
        x = of(x[:-step], x[step:])
        step *= 2
    return x


def _lag_stretches(ids: np.ndarray, lag: int) -> np.ndarray:
    """(start, end, lag) of the longest stretches in which words lag apart are identical."""
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[lag:] == ids[:-lag]
    turns = np.flatnonzero(np.diff(same))
    return np.stack([turns[::2], turns[1::2] + lag, np.full(len(turns) // 2, lag)], 1)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words are the same from a and b on (a < b), or before them; blocks of falling size are compared."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size, open_ = 1 << k, np.ones(len(a), bool)
        while open_.any():
            at = np.flatnonzero(open_)
            x, y = (a[at] - total[at] - size, b[at] - total[at] - size) if back else (a[at] + total[at], b[at] + total[at])
            inside = (x >= 0) & (y < len(levels[k]))
            same = np.zeros(len(at), bool)
            same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
            total[at[same]] += size
            open_[at[~same]] = False
            if k < len(levels) - 1:  # only the largest blocks can fit more than once
                break
    return total


def _seeds(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of neighbouring equal minimizers whose distance is a period of this scale."""
    window = size // 2
    if len(grams) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros(len(grams) + window - 1, np.uint64)
    least = _extreme(grams, window, np.minimum)
    padded[window - 1 : window - 1 + len(least)] = least
    at = np.flatnonzero(_extreme(padded, window, np.maximum) == grams)
    at = at[np.argsort(grams[at], kind="stable")]
    a, b = at[:-1], at[1:]
    seed = (grams[a] == grams[b]) & (b - a > window) & (b - a <= size)
    return a[seed], b[seed]


def runs_of(ids: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs of ids, by start, then period. No run is longer than longest."""
    found = [_lag_stretches(ids, lag) for lag in range(1, min(SHORT, longest // LEAST_PERIODS, len(ids) - 1) + 1)]
    levels, size = [_mixed(ids.astype(np.uint64), np.uint64(1))], 1
    while 2 * size <= len(ids) and (size < SHORT or size < longest // LEAST_PERIODS):
        levels.append(_mixed(levels[-1][:-size], levels[-1][size:]))
        size *= 2
        if size > SHORT:
            a, b = _seeds(levels[-1], size)
            if len(a):
                start, end = a - _common(levels, a, b, True), b + _common(levels, a, b, False)
                found.append(_checked(ids, np.unique(np.stack([start, end, b - a], 1), axis=0)))
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    length = runs[:, 1] - runs[:, 0]
    runs = np.unique(runs[(length >= LEAST_LENGTH) & (length >= LEAST_PERIODS * runs[:, 2])], axis=0)
    # Of equal stretches the first has the smallest period, which divides the others.
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _checked(ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The runs, after a comparison of their words; should hashes have misled, the lags at fault are scanned."""
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST_PERIODS * runs[:, 2]]
    right = [
        np.array_equal(ids[s : e - q], ids[s + q : e]) and (s == 0 or ids[s - 1] != ids[s - 1 + q]) and (e == len(ids) or ids[e] != ids[e - q])
        for s, e, q in runs.tolist()
    ]
    if all(right):
        return runs
    lags = {q for (_, _, q), ok in zip(runs.tolist(), right, strict=True) if not ok}
    return np.concatenate([runs[right], *(_lag_stretches(ids, q) for q in sorted(lags))])


def _chunks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()  # of bytes, the blanks are x20 and x09-x0D
        if part and size + len(words) > CHUNK_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    yield part


def collapse(texts: list[str | None]) -> Iterator[tuple[list[dict], str]]:
    """For each text its runs and the words that remain when each run keeps its first period, joined by a space."""
    for part in _chunks(texts):
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in part])])
        ids = np.empty(starts[-1], np.int64)
        for k, (w, at) in enumerate(zip(part, starts.tolist(), strict=False)):
            ids[at : at + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
            ids[at + len(w)] = -1 - k
        runs = runs_of(ids, max(map(len, part), default=0))
        edges = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 1], -1)
        kept = np.cumsum(edges[:-1]) == 0
        bounds = np.searchsorted(runs[:, 0], starts)
        for k, w in enumerate(part):
            own = runs[bounds[k] : bounds[k + 1]]
            if len(own):
                w = [x for x, keep in zip(w, kept[starts[k] : starts[k] + len(w)].tolist(), strict=True) if keep]
            yield (
                [{"start": s - int(starts[k]), "length": e - s, "period": q} for s, e, q in own.tolist()],
                b" ".join(w).decode("utf-8", "surrogatepass"),
            )


def collapse_runs(docs: DataFrame, text: str = "text", runs: str | None = None, collapsed: str | None = None) -> DataFrame:
    """docs with the runs of a text column (array of start, length, period) and the text with every run cut to its first
    period. The new columns are called runs and collapsed, or as given, with _ added where docs has such a name."""

    @F.arrow_udf("struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")
    def found(texts: pa.Array) -> pa.Array:
        rows = list(collapse(texts.to_pylist()))
        return pa.StructArray.from_arrays([pa.array([r for r, _ in rows], RUNS), pa.array([c for _, c in rows], pa.string())], ["runs", "collapsed"])

    both = free_name(docs, "found")
    names = free_name(docs, runs or "runs"), free_name(docs, collapsed or "collapsed")
    out = docs.withColumn(both, found(F.col(text)))
    return out.withColumns({names[0]: F.col(f"{both}.runs"), names[1]: F.col(f"{both}.collapsed")}).drop(both)
