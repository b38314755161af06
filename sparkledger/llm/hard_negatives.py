"""Hard-negative mining by threshold joins over inverted indexes with norm bounds.

For each anchor the best rows of its own label are its positives; for each positive the best rows of other labels whose
score lies in a window below the positive's are its hard negatives. A score is the inner product of integer vectors.

Both searches are threshold joins that are repeated with lower thresholds until each window is full: the first round
asks only for scores near the top, the windows with enough rows are done, the others come again with a lower threshold,
and the last round has the window's own lower end. A full window is final, since all rows above its threshold were
seen.

A round deals rows and anchors into blocks; each pair of blocks meets in one group of the shuffle. In it the rows'
dimensions form an inverted index, the heaviest dimensions first, STEP of them at a time. A row's postings end where the
norm of the rest of it, times the largest norm of the rest of an anchor, cannot reach the lowest threshold. The partial
scores of an anchor block are accumulated over the postings; after each step rows fall out that no anchor can
still reach by the norms of what remains. Pairs left at the end of a row's postings get the missing dimensions step by
step and fall out in the same way. A group returns the best rows of each window only, so that a label, a vector or a
score shared by a third of all rows costs no more than others.

A group holds ROW_BLOCK rows and ANCHOR_BLOCK anchors at most, whatever the table's size; rows are dealt by number, not
by value. Nothing but the largest norm and the counts of rows and of anchors goes to the driver.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; a null id comes
last among equal scores and stays null in the result; repeated rows each count, and each repeated anchor has rows of its
own; of vectors of different lengths the missing components count as zero; an anchor without another row of its label,
or a positive whose window is empty (as for a negative score), has no rows; an empty table gives an empty result; other
columns are not read. A score beyond a long raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: The most rows and anchors in a group, and the least rows for which another block is made.
ROW_BLOCK, ANCHOR_BLOCK, LEAST_BLOCK = 1 << 17, 1 << 16, 512
#: Dimensions accumulated between two prunings, and partial scores held at once.
STEP, CELLS = 8, 1 << 22
#: Thresholds of the rounds: for positives as a share of the largest possible score (then none), for negatives as a share of the window, from its upper end.
SCORE_FALLS, WINDOW_FALLS = (0.5, 0.25, 0.1), (1 / 16, 1 / 4)
LAST, NEVER = (1 << 63) - 1, -(1 << 62)


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """The norm of each row from each step on; the last column is zero."""
    squares = np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, x.shape[1], STEP), axis=1) if x.shape[1] else np.zeros((len(x), 0))
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([rest, np.zeros((len(x), 1))], axis=1))


def threshold_join(q: np.ndarray, x: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of all pairs with a score of at least the anchor's low, for slices of the anchors in order."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    heavy = np.argsort(-np.square(x, dtype=np.float64).sum(0), kind="stable")
    q, x = q[:, heavy], x[:, heavy]
    q_rest, x_rest = _suffix_norms(q), _suffix_norms(x)
    largest = float(q_rest[:, 0].max(initial=0)) * float(x_rest[:, 0].max(initial=0))
    if largest >= 2**62:
        raise OverflowError("scores may be beyond a long")
    kind = np.float64 if largest < 2**52 else np.int64  # sums of whole numbers, exact in either
    q, x, slack, steps = q.astype(kind), x.astype(kind), 1 + 1e-9 * largest, q_rest.shape[1] - 1
    # A row's postings end at the first step from which no anchor of the block can gain the lowest threshold.
    covered = x_rest * q_rest.max(0, initial=0) + slack < low.min(initial=LAST)
    ends = np.where(covered.any(1), covered.argmax(1), steps)
    by_end = np.argsort(-ends, kind="stable")
    part = lambda s: slice(s * STEP, (s + 1) * STEP)
    width = max(1, CELLS // max(1, len(x)))
    for at in range(0, len(q), width):
        a, least, rest = q[at : at + width], low[at : at + width].astype(np.float64) - slack, q_rest[at : at + width]
        rows, scores, left = by_end, np.zeros((len(a), len(x)), kind), []
        for s in range(steps + 1):
            n = int(np.searchsorted(-ends[rows], -s, side="left"))  # the postings of the others have ended
            near, end = np.nonzero(scores[:, n:] + rest[:, s, None] * x_rest[rows[n:], s] >= least[:, None])
            left.append((near, rows[n:][end], scores[near, n + end], s))
            rows, scores = rows[:n], scores[:, :n]
            if not n:
                break
            scores = scores + a[:, part(s)] @ x[rows, part(s)].T
            open_ = (scores + rest[:, s + 1, None] * x_rest[rows, s + 1] >= least[:, None]).any(0)
            if open_.mean() < 0.7:
                rows, scores = rows[open_], scores[:, open_]
        for near, row, score, s in left:
            for k in range(s, steps):
                score = score + np.einsum("ij,ij->i", a[near, part(k)], x[row, part(k)])
                open_ = score + rest[near, k + 1] * x_rest[row, k + 1] >= least[near]
                near, row, score = near[open_], row[open_], score[open_]
            sure = score >= low[at + near]
            yield at + near[sure], row[sure], score[sure].astype(np.int64)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _best(anchors: pa.Table, rows: pa.Table, same: bool, keep: int) -> pa.Table:
    """The first rows of each window of each anchor, within two blocks."""
    own = [c.to_numpy() for c in (anchors["anchor"], anchors["label"])]
    uid, ids, label = (rows[c].to_numpy() for c in ("uid", "id", "label"))
    sizes = np.diff(anchors["windows"].combine_chunks().offsets.to_numpy())
    wide = anchors["windows"].combine_chunks().flatten()
    k, low, high = (wide.field(c).to_numpy() for c in ("k", "low", "high"))
    start = np.cumsum(sizes) - sizes
    found = []
    for a, r, score in threshold_join(_vectors(anchors["v"]), _vectors(rows["v"]), np.minimum.reduceat(low, start)):
        fits = ((label[r] == own[1][a]) & (uid[r] != own[0][a])) if same else label[r] != own[1][a]
        a, r, score = a[fits], r[fits], score[fits]
        order = np.lexsort((uid[r], ids[r], -score, a))
        a, r, score = a[order], r[order], score[order]
        for n in range(int(sizes.max(initial=0))):
            w = np.minimum(start[a] + n, len(k) - 1)
            inside = (n < sizes[a]) & (score >= low[w]) & (score <= high[w])
            b = a[inside]
            first = np.arange(len(b)) - np.searchsorted(b, b) < keep
            at = np.flatnonzero(inside)[first]
            found.append((own[0][a[at]], k[w[at]], uid[r[at]], ids[r[at]], score[at]))
    cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
    return pa.table([pa.array(c.astype(np.int64)) for c in cols], ["anchor", "k", "uid", "id", "score"])


def _search(anchors: DataFrame, windows: DataFrame, rows: DataFrame, n_rows: int, same: bool, keep: int) -> DataFrame:
    """(anchor, k, rank, uid, id, score): the first keep rows of each window (anchor, k, low, high), all rows seen."""
    spark = rows.sparkSession
    asked = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("windows"))
    asked = materialise(anchors.join(asked, "anchor"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_row = max(1, math.ceil(n_rows / ROW_BLOCK), min(parts, math.ceil(n_rows / LEAST_BLOCK)))
    n_anchor = max(1, math.ceil(asked.count() / ANCHOR_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", deal("anchor", n_anchor).alias("a_block")).select("*", every(n_row).alias("r_block"))
    right = rows.select("*", deal("uid", n_row).alias("r_block")).select("*", every(n_anchor).alias("a_block"))
    pairs = left.groupBy("a_block", "r_block").cogroup(right.groupBy("a_block", "r_block"))
    best = pairs.applyInArrow(lambda a, r: _best(a, r, same, keep), "anchor bigint, k bigint, uid bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id", "uid")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _filled(anchors: DataFrame, windows: DataFrame, rows: DataFrame, n_rows: int, same: bool, keep: int, falls: list[Callable[[], Column]]) -> DataFrame:
    """_search in rounds with the falls as lower ends; a window that is full is done."""
    done = None
    for n, fall in enumerate(falls):
        got = materialise(_search(anchors, windows.withColumn("low", F.greatest("low", fall().cast("long"))), rows, n_rows, same, keep))
        last = n == len(falls) - 1
        full = got.where(F.col("rank") == keep).select("anchor", "k")
        part = got if last else got.join(full, ["anchor", "k"], "left_semi")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        windows = materialise(windows.join(full, ["anchor", "k"], "left_anti"))
        if windows.isEmpty():
            break
    return done


def prepare(rows: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(uid, id, label, v, norm) of the rows that take part, with components floor(scale * x); written once."""
    fit = F.col(label).isNotNull() & F.col(vector).isNotNull()
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    d = rows.where(fit & ~F.coalesce(odd, F.lit(False)))
    d = d.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return materialise(d.select(F.monotonically_increasing_id().alias("uid"), "*", norm.alias("norm")))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of prepare().

    is_anchor is a condition on id. Each anchor has its first positives other rows of its label, each of them the first
    negatives rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Higher
    scores come first, ties by smaller id."""
    n_rows = rows.count()
    most = rows.agg(F.max("norm")).first()[0] or 0.0
    chosen = rows.where(is_anchor & (F.col("id") != LAST)).select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"), "label", "v", "norm")
    anchors = materialise(chosen)
    vectors = anchors.select("anchor", "label", "v")
    rows = rows.drop("norm")
    windows = anchors.select("anchor", "norm", F.lit(0).cast("long").alias("k"), F.lit(NEVER).alias("low"), F.lit(LAST).alias("high"))
    falls = [*((lambda c=c: F.floor(F.col("norm") * most * c)) for c in SCORE_FALLS), lambda: F.lit(NEVER)]
    best = _filled(vectors, windows, rows, n_rows, True, positives, falls)
    score = F.col("positive_score")
    best = best.select("anchor", F.col("rank").cast("long").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = materialise(best.join(anchors.select("anchor", "anchor_id"), "anchor"))
    to = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")
    since = F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100)) div 100")
    windows = materialise(best.where(F.lit(low) * score <= F.lit(high) * score).select("anchor", "k", since.alias("low"), to.alias("high")).where("low <= high"))
    falls = [*((lambda f=f: F.floor(F.col("high") - (F.col("high") - F.col("low")) * f)) for f in WINDOW_FALLS), lambda: F.col("low")]
    worst = _filled(vectors, windows, rows, n_rows, False, negatives, falls)
    named = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return worst.join(best, ["anchor", "k"]).select(
        "anchor_id",
        named("positive_id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        named("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
