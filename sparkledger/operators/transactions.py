"""Canonical transactions: projection, validation, identity, profiling, time splits, preprocessing."""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import exact_percentile

# The columns of each source dialect, canonical name first.
DIALECTS = {
    "paysim": {"step": "step", "transaction_type": "type", "amount": "amount", "initiator_id": "nameOrig", "recipient_id": "nameDest", "label_is_fraud": "isFraud"},
    "momtsim": {"step": "step", "transaction_type": "transactionType", "amount": "amount", "initiator_id": "initiator", "recipient_id": "recipient", "label_is_fraud": "isFraud"},
}
NUMERIC = ["amount", "amount_log1p", "hour_sin", "hour_cos"]
UNKNOWN = "__UNKNOWN__"


def opaque_row_id(source: Column, source_hash: Column, row_no: Column) -> Column:
    return F.sha2(F.concat_ws(chr(0), source, source_hash, row_no.cast("string")), 256)


def canonicalize(raw: DataFrame, dialect: str, source: str, source_hash: str, row_no: str = "row_no") -> DataFrame:
    """Text columns of a dialect to canonical types; what does not parse is null and left to quarantine()."""
    c = DIALECTS[dialect]
    return raw.select(
        F.lit(source).alias("dataset_source"),
        opaque_row_id(F.lit(source), F.lit(source_hash), F.col(row_no)).alias("source_row_id"),
        F.trim(c["step"]).try_cast("int").alias("step"),
        F.upper(F.trim(c["transaction_type"])).alias("transaction_type"),
        F.trim(c["amount"]).try_cast("double").alias("amount"),
        F.trim(c["initiator_id"]).alias("initiator_id"),
        F.trim(c["recipient_id"]).alias("recipient_id"),
        F.trim(c["label_is_fraud"]).try_cast("int").alias("label_is_fraud"),
    )


def codes(**rules: Column) -> Column:
    """The sorted codes whose rule holds; a null rule does not."""
    return F.array_compact(F.array(*(F.when(rules[k], F.lit(k)) for k in sorted(rules))))


def with_error_codes(tx: DataFrame) -> DataFrame:
    amount = F.col("amount")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return tx.withColumn(
        "error_codes",
        codes(
            BAD_AMOUNT=amount.isNull() | F.isnan(amount) | (amount < 0) | (amount == float("inf")),
            BAD_LABEL=F.col("label_is_fraud").isNull() | ~F.col("label_is_fraud").isin(0, 1),
            BAD_STEP=F.col("step").isNull() | (F.col("step") < 0),
            EMPTY_INITIATOR=blank("initiator_id"),
            EMPTY_RECIPIENT=blank("recipient_id"),
            EMPTY_TYPE=blank("transaction_type"),
        ),
    )


def quarantine(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = with_error_codes(tx)
    return marked.where(F.size("error_codes") == 0).drop("error_codes"), marked.where(F.size("error_codes") > 0)


def actor_role(c: Column) -> Column:
    first = F.upper(F.substring(c, 1, 1))
    return F.when(first == "C", "CUSTOMER").when(first == "M", "MERCHANT").otherwise("UNKNOWN")


def encodings(tx: DataFrame) -> DataFrame:
    angle = 2 * F.pi() * F.pmod("step", F.lit(24)) / 24
    return tx.withColumns({"amount_log1p": F.log1p("amount"), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def step_statistics(tx: DataFrame) -> DataFrame:
    return tx.groupBy("step").agg(F.count("*").alias("n_rows"), F.sum("label_is_fraud").alias("positives"))


def time_split(stats: DataFrame, min_pos: int = 0) -> tuple[list[tuple[str, int, int]], bool]:
    """((partition, first step, last step), whether min_pos is met): cuts at 70, 80 and 90 % of the steps, or the nearest cuts
    that leave at least min_pos positives in tuning, calibration and test (of equally near ones the smallest). stats has a
    row for each step, hundreds at most. For a given second cut the best first and third are the ones nearest to their
    targets in the ranges that the positives allow, so each second cut is looked at once."""
    rows = sorted((r["step"], r["positives"]) for r in stats.collect())
    n = len(rows)
    if n < 4:
        raise ValueError("a split needs four steps")
    target = [max(n * 70 // 100, 1)]
    target[0] = min(target[0], n - 3)
    for k, p in ((2, 80), (3, 90)):
        target.append(min(max(n * p // 100, target[-1] + 1), n - 4 + k))
    before = [0, *itertools.accumulate(p for _, p in rows)]
    best, met = tuple(target), True
    if min_pos:
        fits = []
        last_third = bisect.bisect_right(before, before[n] - min_pos) - 1
        for second in range(2, n - 1):
            last_first = bisect.bisect_right(before, before[second] - min_pos) - 1
            first_third = max(second + 1, bisect.bisect_left(before, before[second] + min_pos))
            lo, hi = 1, min(second - 1, last_first)
            if lo <= hi and first_third <= min(n - 1, last_third):
                cuts = (min(max(target[0], lo), hi), second, min(max(target[2], first_third), min(n - 1, last_third)))
                fits.append((sum(abs(a - b) for a, b in zip(cuts, target, strict=True)), cuts))
        met = bool(fits)
        best = min(fits)[1] if fits else best
    edges = [0, *best, n]
    return [(name, rows[a][0], rows[b - 1][0]) for name, a, b in zip(("train", "tuning", "calibration", "test"), edges, edges[1:], strict=False)], met


def plan_time_split(stats: DataFrame, min_pos: int = 0) -> list[tuple[str, int, int]]:
    return time_split(stats, min_pos)[0]


def split_plan(stats: DataFrame, min_pos: int = 0) -> DataFrame:
    """(partition, first_step, last_step, enforced): the plan as a table of four rows."""
    plan, met = time_split(stats, min_pos)
    return stats.sparkSession.createDataFrame([(*p, met) for p in plan], "partition string, first_step int, last_step int, enforced boolean")


def assign_partition(tx: DataFrame, plan: list[tuple[str, int, int]]) -> DataFrame:
    """partition by the plan's step ranges (four rows, so a case expression); outside them it is null."""
    part = F.lit(None).cast("string")
    for name, a, b in plan:
        part = F.when(F.col("step").between(a, b), name).otherwise(part)
    return tx.withColumn("partition", part)


def partition_summary(parted: DataFrame) -> DataFrame:
    return parted.groupBy("partition").agg(
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
        F.count_distinct("step").alias("n_steps"),
        F.count("*").alias("n_rows"),
        F.sum("label_is_fraud").alias("positives"),
        F.round(F.sum("label_is_fraud") / F.count("*"), 6).alias("prevalence"),
    )


def safe_eda(parted: DataFrame) -> DataFrame:
    """Counts and amounts by type, of train and tuning rows only."""
    return (
        parted.where(F.col("partition").isin("train", "tuning"))
        .groupBy("partition", "transaction_type")
        .agg(
            F.count("*").alias("n_rows"),
            F.sum("label_is_fraud").alias("positives"),
            F.min("amount").alias("min_amount"),
            F.max("amount").alias("max_amount"),
            F.round(F.avg("amount"), 6).alias("mean_amount"),
        )
    )


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row: mean_<c> of each numeric (0 where none), vocabulary_<c> of each categorical, sorted, with the unknown mark."""
    return train.agg(
        *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in numeric),
        *(F.concat(F.array_sort(F.collect_set(c)), F.array(F.lit(UNKNOWN))).alias(f"vocabulary_{c}") for c in categorical),
    )


def apply_preprocessor(df: DataFrame, fitted: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """fitted has one row, joined by broadcast."""
    joined = df.crossJoin(F.broadcast(fitted))
    out = {c: F.coalesce(c, f"mean_{c}") for c in numeric}
    out |= {c: F.when(F.array_contains(f"vocabulary_{c}", F.col(c)), F.col(c)).otherwise(UNKNOWN) for c in categorical}
    return joined.withColumns(out).select(*df.columns)


def fit_imputer(train: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row: the exact median of each numeric, the most frequent value of each categorical (the smallest among equals).

    Values are counted first; no task holds all different values."""
    out = train.sparkSession.range(1).select()
    for c in numeric:
        out = out.crossJoin(F.broadcast(exact_percentile(train, c, 0.5).withColumnRenamed("percentile", f"median_{c}")))
    for c in categorical:
        counts = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n").alias("n"))
        out = out.crossJoin(F.broadcast(counts.join(F.broadcast(most), "n").agg(F.min(c).alias(f"mode_{c}"))))
    return out


def profile(tx: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, positives, different steps, null cells, invalid amounts and labels, surplus copies by key (which has the step)."""
    null_cells = sum((F.col(c).isNull().cast("int") for c in tx.columns), F.lit(0))
    groups = tx.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum("label_is_fraud").alias("p"), F.sum(null_cells).alias("z"),
        F.count_if(F.col("amount").isNull() | (F.col("amount") < 0)).alias("a"), F.count_if(~F.coalesce(F.col("label_is_fraud").isin(0, 1), F.lit(False))).alias("l"),
    )
    return groups.agg(
        F.sum("n").alias("n_rows"), F.sum("p").alias("positives"), F.count_distinct("step").alias("n_steps"), F.sum("z").alias("null_cells"), F.sum("a").alias("invalid_amounts"), F.sum("l").alias("invalid_labels"),
        (F.sum("n") - F.count("*")).alias("duplicate_rows"),
    )


def drift_reasons(observed: DataFrame, expected: dict[str, int]) -> DataFrame:
    """The sorted codes of the measures that differ from the registered ones."""
    return observed.select(F.array_join(codes(**{f"{k.upper()}_DRIFT": ~F.col(k).eqNullSafe(F.lit(v)) for k, v in expected.items()}), ",").alias("reasons"))


def row_hash(*cols: str) -> Column:
    """sha256 of all values as a JSON object, so that no value can run into the next; nulls are written out."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def first_occurrences(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in source order, with the number of its copies.

    One aggregation with map-side combining, so that a key of very many copies never meets in one task."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("r")
    return df.groupBy(*key).agg(first, F.count("*").alias("copies")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest), "copies")


def dedup_manifest(df: DataFrame, key: list[str], label: str) -> DataFrame:
    groups = df.groupBy(*key).agg(F.count("*").alias("n"), F.sum(label).alias("p"), F.max(label).alias("kept"))
    return groups.agg(
        F.sum("n").alias("rows_in"), F.count("*").alias("rows_out"), (F.sum("n") - F.count("*")).alias("removed"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.max("n").alias("max_group"),
        F.sum("p").alias("positives_before"), F.sum("kept").alias("positives_after"), (F.sum("p") - F.sum("kept")).alias("positives_removed"),
    )


def stratified_cap(df: DataFrame, max_rows: int, key: str, label: str, seed: str = "42") -> DataFrame:
    """At most max_rows / 2 positives, the rest negatives, by hash order; unchanged if small enough.

    The quotas need one count; each class is cut with a bounded top-k rather than a ranked window."""
    n = df.count()
    if n <= max_rows:
        return df
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    positives = df.where(F.col(label) == 1).orderBy(order, key).limit(max_rows // 2)
    taken = positives.count()
    return positives.unionByName(df.where(F.col(label) == 0).orderBy(order, key).limit(max_rows - taken))


def hash_subset(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """(label, n, weight = all / (classes * n)); the totals come from the few class rows."""
    c = train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t)).select("label", "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 8).alias("weight"))


def latest_per_key(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key, nulls last, ties by the larger id; combined map-side."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), F.col(at), F.col(tie)))
    return df.groupBy(key).agg(best.alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def recent_n(df: DataFrame, key: str, at: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
