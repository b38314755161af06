"""Queries of the model operators. Fitted models have no SQL; tests hold their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, evaluation, models
from ..sources.scratch import stored
from .catalog import parted, query

_FEATURES = ["amount", "step_of_day", "prior_24h_count", "prior_24h_amount"]


def _rows(tx):
    """The rows of all fits and scores, worked out once: a fit reads its rows many times, and each score reads them again."""
    d = causal.velocity(parted(tx)).withColumn("step_of_day", F.col("step") % 24)
    return stored(d.select("partition", "transaction_type", F.col("label_is_fraud").alias("label"), *(F.col(c).cast("double").alias(c) for c in _FEATURES)))


@query(None, "tx")
def e11_e14_candidates(tx):
    d = _rows(tx)
    return models.fit_candidates(d.where("partition = 'train'"), d.where("partition = 'tuning'"), _FEATURES, categorical=["transaction_type"])


@query("SELECT CAST(row_number() OVER (ORDER BY ap DESC, recall DESC, brier, candidate) AS INT) AS rank, candidate, seed, ap AS average_precision, recall, brier FROM (SELECT engine AS candidate, arg_max(record_id, cer * 1000000 + wer * 1000 - record_id / 1000000000) AS seed, max(cer) AS ap, arg_max(wer, cer * 1000000 + wer * 1000 - record_id / 1000000000) AS recall, arg_max(record_id, cer * 1000000 + wer * 1000 - record_id / 1000000000) / 1000000 AS brier FROM ocr_runs GROUP BY 1)", "ocr_runs")
def e11_rank_candidates(ocr_runs):
    d = ocr_runs.select(F.col("engine").alias("candidate"), F.col("record_id").alias("seed"), F.col("cer").alias("average_precision"), F.col("wer").alias("recall"), (F.col("record_id") / 1_000_000).alias("brier"))
    return models.rank_candidates(d)


@query(None, "scored3", "tx")
def e11_three_class(scored3, tx):
    """Confusion of a three-class forest on the rows that it was not fitted on."""
    d = scored3.select(F.col("id").alias("row_no"), "label").join(tx.select("row_no", "amount", F.col("step").cast("double").alias("step"), "transaction_type"), "row_no")
    fit, rest = d.where("pmod(hash(row_no), 4) <> 0"), d.where("pmod(hash(row_no), 4) = 0")
    s = evaluation.top_class(models.three_class_scores(models.fit_three_class(fit, ["amount", "step"], ["transaction_type"]), rest))
    return s.groupBy(F.col("label").alias("correct")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(None, "tx")
def e12_calibrate(tx):
    d = _rows(tx)
    s = models.scored(models.fit(d.where("partition = 'train'"), _FEATURES, "logistic"), d)
    return models.calibrate(s.where("partition = 'tuning'").select("label", "score"), s.where("partition = 'calibration'").select("label", "score"))


@query(None, "tx")
def e13_cross_source(tx):
    d = _rows(tx)
    parts = {"train": {}, "tuning": {}}
    for p, t in d.where(F.col("partition").isin(*parts) & F.col("transaction_type").isNotNull()).select("partition", "transaction_type").distinct().orderBy("partition", "transaction_type").collect():
        parts[p][t] = stored(d.where((F.col("partition") == p) & (F.col("transaction_type") == t)))
    return models.cross_source({t: models.fit(x, _FEATURES, "logistic") for t, x in parts["train"].items()}, parts["tuning"])


@query("SELECT engine AS candidate, count(*) AS n_seeds, round(avg(cer), 8) AS mean_ap, round(stddev_pop(cer), 8) AS stddev_ap FROM ocr_runs GROUP BY 1", "ocr_runs")
def e14_seed_stability(ocr_runs):
    return models.seed_stability(ocr_runs.select(F.col("engine").alias("candidate"), F.col("cer").alias("average_precision")))
