"""Streams over transactions: causal features per actor, deduplication, step statistics, verification.

A transaction stream has event_time (a timestamp of its step's hour), step, row_no and the columns of a transaction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators import references

HOURS = 24
_OUT = (
    "row_no long, initiator_id string, step int, prior_1h_count long, prior_1h_amount double, prior_6h_count long, prior_6h_amount double, prior_24h_count long, prior_24h_amount double,"
    " prior_mean double, prior_median double, amount_to_median double, steps_since_previous int, unique_recipients int, is_new_recipient int, sequence_pattern string, graph_degree int"
)
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_STEP = "n long, total double, last_row long, last_type string, amounts array<double>, counts array<long>, sent array<string>, linked array<string>"
_WAITING = "rows array<long>, amounts array<double>, others array<string>, types array<string>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR = 3_600_000


@dataclass
class _Step:
    """What later steps need of one: count, sum and last row, how often each amount occurred, to whom the actor sent, and who
    is linked to the actor in either direction."""

    n: int = 0
    total: float = 0.0
    last: tuple[int, str | None] | None = None
    amounts: Counter = field(default_factory=Counter)
    sent: set = field(default_factory=set)
    linked: set = field(default_factory=set)

    @staticmethod
    def of(v: tuple | None) -> _Step:
        if v is None:
            return _Step()
        n, total, row, kind, amounts, counts, sent, linked = v
        last = None if row is None else (row, kind)
        return _Step(n, total, last, Counter(dict(zip(list(amounts), list(counts), strict=True))), set(sent), set(linked))

    def value(self) -> tuple:
        amounts = sorted(self.amounts)
        return self.n, self.total, *(self.last or (None, None)), amounts, [self.amounts[a] for a in amounts], sorted(self.sent), sorted(self.linked)


def _median(counts: Counter) -> float:
    n, seen, low = counts.total(), 0, None
    for a in sorted(counts):
        seen += counts[a]
        if low is None and seen > (n - 1) // 2:
            low = a
        if seen > n // 2:
            return 0.5 * low + 0.5 * a
    raise ValueError("no amounts")


def _step_features(step: int, ready: list[tuple], before: dict[int, _Step]) -> Iterator[tuple]:
    """The features of the rows of a step, from the steps before it. What does not depend on the row is worked out once."""
    own = {s: x for s, x in before.items() if x.n}
    sums = [(sum(x.n for x in w), sum((x.total for x in w), 0.0)) for k in (1, 6, 24) for w in [[x for s, x in own.items() if s >= step - k]]]
    amounts, sent, linked = Counter(), set(), set()
    for x in before.values():
        amounts.update(x.amounts)
        sent |= x.sent
        linked |= x.linked
    n = amounts.total()
    mean, median = (sum(a * k for a, k in amounts.items()) / n, _median(amounts)) if n else (None, None)
    newest = max(own, default=None)
    since, kind_before = (step - newest, own[newest].last[1]) if own else (None, "START")
    for row, amount, other, kind in ready:
        ratio = amount / median if median else None
        yield (row, step, *(v for w in sums for v in w), mean, median, ratio, since, len(sent), int(other not in sent), f"{kind_before}->{kind}", len(linked))


class CausalFeatures(StatefulProcessor):
    """State of an actor by step: rows wait, in a chunk for each micro-batch, until the watermark passes their step; then they are
    answered from the 24 steps before and reduced to a _Step, so rows of one step never see each other. A row that only links
    the actor (the other side sent) is reduced at once. A step is forgotten when no later step can need it.

    So the state is bounded by the steps in the window, the different amounts and counterparties in them, and the rows of
    steps that are still open, however many rows an actor has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step int", _STEP)
        self.waiting = handle.getMapState("waiting", "step int, chunk long", _WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        epoch, new = int(key[1]), set()
        passed = timerValues.getCurrentWatermarkInMs() // _HOUR - epoch
        for frame in rows:
            for step, part in frame[frame["step"] >= passed].groupby("step"):
                step, own = int(step), part[part["own"]]
                known = set(part.loc[~part["own"], "other"].dropna())
                if known:
                    x = _Step.of(self.steps.getValue((step,)) if self.steps.containsKey((step,)) else None)
                    if not known <= x.linked:
                        x.linked |= known
                        self.steps.updateValue((step,), x.value())
                if len(own):
                    text = lambda c: [None if pd.isna(v) else v for v in own[c]]  # noqa: B023, E731
                    self.waiting.updateValue((step, int(own["row_no"].iloc[0])), (own["row_no"].astype(int).tolist(), own["amount"].astype(float).tolist(), text("other"), text("transaction_type")))
                new.add(step)
        for step in new:  # to answer the step, and to forget it
            for hour in (step + 1, step + 1 + HOURS):
                self.handle.registerTimer((hour + epoch) * _HOUR)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hour = expiredTimerInfo.getExpiryTimeInMs() // _HOUR - int(key[1])
        chunks = sorted(k for k in map(tuple, self.waiting.keys()) if k[0] < hour)
        steps = {k[0]: _Step.of(v) for k, v in self.steps.iterator()}
        out = []
        for step in sorted({s for s, _ in chunks}):
            ready = []
            for k in (k for k in chunks if k[0] == step):
                ready += zip(*(list(c) for c in self.waiting.getValue(k)), strict=True)
                self.waiting.removeKey(k)
            ready.sort(key=lambda x: x[0])
            out += _step_features(step, ready, {s: x for s, x in steps.items() if step - HOURS <= s < step})
            x = steps.setdefault(step, _Step())
            for row, amount, other, kind in ready:
                x.n, x.total, x.last = x.n + 1, x.total + amount, (row, kind)
                x.amounts[amount] += 1
                if other is not None:
                    x.sent.add(other)
                    x.linked.add(other)
            self.steps.updateValue((step,), x.value())
        for s in steps:
            if s < hour - HOURS:
                self.steps.removeKey((s,))
        if out:
            frame = pd.DataFrame([(x[0], key[0], *x[1:]) for x in out], columns=_NAMES)
            for c in ("steps_since_previous", "prior_mean", "prior_median", "amount_to_median"):
                frame[c] = frame[c].astype("Int32" if c == "steps_since_previous" else "Float64")
            yield frame

    def close(self) -> None:
        pass


def stream_causal_features(tx: DataFrame, epoch_hours: int, delay: str = "0 seconds") -> DataFrame:
    """tx with event_time; epoch_hours is the hour of step 0 since 1970. Equals the batch windows on the same rows.

    Each transaction goes to its initiator, who gets the features, and to its recipient, for whom it is a link only. The
    session's state store becomes RocksDB, which the operator needs."""
    tx.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    side = lambda actor, other, own: F.struct(F.col(actor).alias("actor"), F.col(other).alias("other"), F.lit(own).alias("own"))
    both = F.explode(F.array(side("initiator_id", "recipient_id", True), side("recipient_id", "initiator_id", False)))
    d = tx.withWatermark("event_time", delay).withColumn("side", both).select("event_time", "step", "row_no", "amount", "transaction_type", "side.*")
    d = d.withColumn("epoch", F.lit(epoch_hours))
    return d.groupBy("actor", "epoch").transformWithStateInPandas(CausalFeatures(), _OUT, "append", "eventTime")


def stream_dedup(tx: DataFrame, key: list[str], ttl: str = "24 hours") -> DataFrame:
    """The first of each key; keys are forgotten once the watermark is past ttl."""
    return tx.withWatermark("event_time", ttl).dropDuplicatesWithinWatermark(key)


def stream_step_stats(tx: DataFrame, delay: str = "1 hour") -> DataFrame:
    w = tx.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 hour").alias("w"))
    return w.agg(F.count("*").alias("n_rows"), F.sum("label_is_fraud").alias("positives")).select(F.col("w.start").alias("start"), "n_rows", "positives")


def stream_velocity(tx: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A coarse alert: counts and amounts of each actor over 24 hours, sliding by one."""
    w = tx.withWatermark("event_time", delay).groupBy("initiator_id", F.window("event_time", "24 hours", "1 hour").alias("w"))
    return w.agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount")).select("initiator_id", F.col("w.start").alias("start"), "n_rows", "amount")


def split_late(batch: DataFrame, newest_step: int | None) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch; rows of steps before newest_step are late."""
    late = F.lit(False) if newest_step is None else F.col("step") < newest_step
    return batch.where(~late), batch.where(late)


def late_aside(path: str, late_path: str, progress: str) -> Callable[[DataFrame, int], None]:
    """What stream_late_aside does with a micro-batch and its number.

    The newest step so far is one row for each batch, in progress; a batch reads that of the batch before it and writes its
    own last, so that its cost does not grow with the batches before it, and a batch that is run again after a failure
    finds what it found at first. All three folders are overwritten by batch. The rows of two batches are kept."""

    def act(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = spark.read.schema("newest long").parquet(f"{progress}/batch={number - 1}").first()[0] if number else None
        for rows, to in zip(split_late(batch, newest), (path, late_path), strict=True):
            rows.write.mode("overwrite").parquet(f"{to}/batch={number}")
        here = spark.read.schema(batch.select("step").schema).parquet(f"{path}/batch={number}").agg(F.max("step")).first()[0]
        top = max((x for x in (newest, here) if x is not None), default=None)
        spark.createDataFrame([(top,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{progress}/batch={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{progress}/batch={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return act


def stream_late_aside(tx: DataFrame, path: str, late_path: str, checkpoint: str, progress: str | None = None) -> StreamingQuery:
    """Write the rows of each micro-batch that are in time to path and the late ones to late_path, before any stateful step,
    which then streams from path. A row is late if an earlier batch had a later step.

    progress is a folder of its own (beside the checkpoint where it is not given) and belongs to the checkpoint: both are
    kept, or both begin anew."""
    return each_batch(tx, late_aside(path, late_path, progress or f"{checkpoint.rstrip('/')}-progress"), checkpoint)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run act on each micro-batch, as verification against stored references does; all available input, then stop."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_verification(obs: DataFrame, refs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Verification status of each micro-batch's observations against the stored (committed) references.

    A batch is written under its own number and overwrites it, so that a batch run again after a failure counts once."""

    def act(batch: DataFrame, number: int) -> None:
        resolved = references.resolve(batch, refs)
        compared = references.compare_fields(batch, refs, resolved)
        out = resolved.join(references.verification_status(compared), "observation_id", "left")
        out.withColumn("verification_status", F.coalesce("verification_status", F.lit("UNVERIFIED"))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each_batch(obs, act, checkpoint)
