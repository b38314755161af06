"""Score curves, metrics, thresholds, calibration, risk policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running

# The classes in their order.
CLASSES = ["GENUINE", "SUSPICIOUS", "FRAUDULENT"]


def threshold_curve(scored: DataFrame, digits: int = 8) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, fpr, f2 at every different score, 0 and 1 too; predicted is score >= threshold.

    Rows are first summed by score; the running sums go over different scores (ranking.running)."""
    by = scored.groupBy(F.col("score").alias("threshold")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    ends = scored.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "threshold double, p long, n long")
    by = by.unionByName(ends).groupBy("threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = scored.agg(F.sum("label").alias("P"), F.sum(1 - F.col("label")).alias("N"))
    summed = running(by, [F.desc("threshold")], {"tp": F.col("p"), "fp": F.col("n")})
    d = summed.select("threshold", "tp", "fp").crossJoin(F.broadcast(total))
    d = d.withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), digits)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return d.select(
        "threshold", "tp", "fp", "fn", "tn",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, F.col("N")).alias("fpr"), ratio(5 * tp, 5 * tp + 4 * fn + fp).alias("f2"),
    )


def binary_metrics(scored: DataFrame) -> DataFrame:
    """One row: n, prevalence, average precision (step sum), ROC AUC with tied ranks, Brier score, and the counts and rates
    of predicting where the score is 0.5 at least; null where no row, or one class only, leaves a measure undefined."""
    by = scored.groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    c = running(by, [F.desc("score")], {"tp": F.col("p"), "k": F.col("n")})
    # A score's rank from below is the number of all rows less those down to it.
    s = c.agg(F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("ap"), F.sum(F.col("p") * ((F.col("n") + 1) / 2 - F.col("k"))).alias("ranks"), F.sum("p").alias("P"), F.sum("n").alias("T"))
    hit, pos = F.col("score") >= 0.5, F.col("label") == 1
    other = scored.agg(
        F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
        F.count_if(hit & pos).alias("tp_05"), F.count_if(hit & ~pos).alias("fp_05"), F.count_if(~hit & pos).alias("fn_05"), F.count_if(~hit & ~pos).alias("tn_05"),
    )
    p, n = F.col("P"), F.col("T") - F.col("P")
    tp, fp, fn, tn = (F.col(f"{k}_05") for k in ("tp", "fp", "fn", "tn"))
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 8)
    return s.crossJoin(F.broadcast(other)).select(
        F.col("T").alias("n_rows"), F.round(p / F.col("T"), 8).alias("prevalence"), F.round(F.try_divide("ap", p), 8).alias("average_precision"),
        F.round(F.try_divide(F.col("ranks") + p * F.col("T") - p * (p + 1) / 2, p * n), 8).alias("roc_auc"), F.round("brier", 8).alias("brier"), tp, fp, fn, tn,
        rate(tp, tp + fp).alias("precision_05"), rate(tp, tp + fn).alias("recall_05"), rate(2 * tp, 2 * tp + fp + fn).alias("f1_05"), rate(fp, fp + tn).alias("fpr_05"), rate(fn, fn + tp).alias("fnr_05"),
    )


def recall_under_fpr(curve: DataFrame, cap: float) -> DataFrame:
    return curve.where(F.col("fpr") <= cap).agg(F.max("recall").alias("recall"))


def select_risk_thresholds(curve: DataFrame, cap: float, precision: float) -> DataFrame:
    """One row (medium, high, medium_rule, high_rule).

    medium: the largest F2 under the FPR cap (ties: recall, lower FPR, lower threshold), of all thresholds where none is under
    it. high: the lowest threshold from medium on that reaches the precision; where none does, the largest (precision,
    recall, threshold) from medium on."""
    under = F.col("fpr") <= cap
    medium = curve.agg(F.max_by("threshold", F.struct(under.alias("u"), "f2", "recall", -F.col("fpr"), -F.col("threshold"))).alias("medium"), F.max(under).alias("met"))
    above = curve.crossJoin(F.broadcast(medium)).where(F.col("threshold") >= F.col("medium"))
    found = above.groupBy("medium", "met").agg(F.min(F.when(F.col("precision") >= precision, F.col("threshold"))).alias("h"), F.max_by("threshold", F.struct("precision", "recall", "threshold")).alias("best"))
    return found.select(
        "medium", F.coalesce("h", "best").alias("high"),
        F.when(F.col("met"), "maximize_f2_subject_to_fpr_cap").otherwise("fallback_maximize_f2_no_threshold_met_fpr_cap").alias("medium_rule"),
        F.when(F.col("h").isNull(), "fallback_maximize_precision_target_unmet").otherwise("lowest_threshold_meeting_precision_target").alias("high_rule"),
    )


def classify_band(scored: DataFrame, medium: float, high: float) -> DataFrame:
    return scored.withColumn("band", F.when(F.col("score") >= high, "HIGH").when(F.col("score") >= medium, "MEDIUM").otherwise("LOW"))


def risk_scalar(scored3: DataFrame) -> DataFrame:
    """p_fraudulent + p_suspicious / 2, and whether the three sum to 1 within 1e-6."""
    total = F.col("p_genuine") + F.col("p_suspicious") + F.col("p_fraudulent")
    return scored3.withColumns({"risk": F.round(F.col("p_fraudulent") + F.col("p_suspicious") / 2, 9), "valid": F.abs(total - 1) <= 1e-6})


def grid_thresholds(scored3: DataFrame) -> DataFrame:
    """Macro-F1 and fraud recall of each pair (s, f) of the grid: a risk of f is fraudulent, one of s suspicious.

    Rows are summed by the grid cells of their risks first."""
    spark = scored3.sparkSession
    grid = [(s / 100, f / 100) for s in range(5, 65, 5) for f in range(max(40, s + 5), 100, 5)]
    g = spark.createDataFrame(grid, "s double, f double")
    risk = F.col("p_fraudulent") + F.col("p_suspicious") / 2
    cells = scored3.groupBy("label", F.floor(F.round(risk * 20, 9)).alias("c")).agg(F.count("*").alias("n"))
    at = lambda c: F.round(F.col(c) * 20, 6)
    pred = F.when(F.col("c") >= at("f"), "FRAUDULENT").when(F.col("c") >= at("s"), "SUSPICIOUS").otherwise("GENUINE")
    d = cells.crossJoin(F.broadcast(g)).withColumn("pred", pred)
    one = {k: (F.sum(F.when((F.col("label") == k) & (F.col("pred") == k), F.col("n")).otherwise(0)), F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)), F.sum(F.when(F.col("pred") == k, F.col("n")).otherwise(0))) for k in CLASSES}
    f1 = [F.when(a + b > 0, 2 * t / (a + b)).otherwise(F.lit(0.0)) for t, a, b in one.values()]
    t, a, _ = one["FRAUDULENT"]
    return d.groupBy("s", "f").agg(F.round(sum(f1[1:], f1[0]) / 3, 8).alias("macro_f1"), F.round(F.when(a > 0, t / a).otherwise(F.lit(0.0)), 8).alias("fraud_recall"))


def choose_grid_thresholds(grid: DataFrame) -> DataFrame:
    """One row: the pair of the largest macro-F1, then fraud recall, then lower thresholds (fraudulent first)."""
    best = F.max(F.struct("macro_f1", "fraud_recall", (-F.col("f")).alias("f"), (-F.col("s")).alias("s"))).alias("b")
    return grid.agg(best).select((-F.col("b.s")).alias("suspicious"), (-F.col("b.f")).alias("fraudulent"), "b.macro_f1", "b.fraud_recall")


def choose_binary_threshold(grid: DataFrame) -> DataFrame:
    """One row: the threshold of the largest mean F1, then recall, then the lower one."""
    best = F.max(F.struct("mean_f1", "recall", (-F.col("t")).alias("t"))).alias("b")
    return grid.agg(best).select((-F.col("b.t")).alias("threshold"), "b.mean_f1", "b.recall")


def calibration_bins(scored: DataFrame, bins: int = 5) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    squared = F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("squared_error")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_rate"), squared)


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: expected calibration error, Brier score."""
    ece = F.round(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_rate"))) / F.sum("n"), 6)
    return bins.agg(ece.alias("ece"), F.round(F.sum("squared_error") / F.sum("n"), 6).alias("brier"))


def top_class(scored3: DataFrame) -> DataFrame:
    """scored3 (label, a probability of each class) as (score, label, squared_error): the largest probability, whether its
    class (the first among equals) is the label, and the squared distance of the probabilities from the label."""
    ps = [F.col(f"p_{c.lower()}") for c in CLASSES]
    first = F.lit(CLASSES[-1])
    for c, p in reversed(list(zip(CLASSES[:-1], ps[:-1], strict=True))):
        first = F.when(p == F.greatest(*ps), c).otherwise(first)
    squared = sum((F.pow(p - (F.col("label") == c).cast("int"), 2) for c, p in zip(CLASSES, ps, strict=True)), F.lit(0.0))
    return scored3.select(F.greatest(*ps).alias("score"), (first == F.col("label")).cast("int").alias("label"), squared.alias("squared_error"))


def multiclass_calibration(scored3: DataFrame, bins: int = 5) -> DataFrame:
    """One row: multiclass Brier score, and the calibration error of the top class."""
    d = top_class(scored3)
    brier = d.agg(F.round(F.avg("squared_error"), 6).alias("multiclass_brier"))
    return brier.crossJoin(F.broadcast(calibration_error(calibration_bins(d.drop("squared_error"), bins)).select("ece")))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the confusion counts."""
    tp = conf.where("label = predicted").select(F.col("label").alias("class"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"))
    got = conf.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    d = sup.join(got, "class", "full_outer").join(tp, "class", "left").na.fill(0)
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 8)
    return d.select("class", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def report_summary(report: DataFrame) -> DataFrame:
    """One row: macro-F1 over all classes, balanced accuracy over those that occur, rows."""
    recall = F.avg(F.when(F.col("support") > 0, F.col("recall")))
    return report.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(recall, 6).alias("balanced_accuracy"), F.sum("support").alias("n_rows"))


# The policy, and the reasons that it gives: code, title and severity.
CRITICAL_FIELDS = {"amount": "Amount differs from the stored record", "transaction_reference": "Transaction reference differs from the stored record"}
CLASS_BANDS = {"GENUINE": "low_risk", "SUSPICIOUS": "medium_risk", "FRAUDULENT": "high_risk"}
IMAGE_HIGH = 0.85
CLASS_REASONS = {
    "GENUINE": ("STRUCTURED_MODEL_LOW_RISK", "The accepted structured model emitted its low-risk class", "LOW"),
    "SUSPICIOUS": ("STRUCTURED_MODEL_MEDIUM_RISK", "The accepted structured model emitted its review class", "MEDIUM"),
    "FRAUDULENT": ("STRUCTURED_MODEL_HIGH_RISK", "The accepted structured model emitted its high-risk class", "HIGH"),
}
IMAGE_REASON = ("IMAGE_MODEL_TAMPER_THRESHOLD_EXCEEDED", "The accepted image model found manipulation indicators", "HIGH")
INSUFFICIENT = ("INSUFFICIENT_EVIDENCE", "Available evidence cannot support a fraud-risk conclusion", "INFORMATIONAL")
RISK_CLASSES = {"low_risk": "LOW", "medium_risk": "MEDIUM", "high_risk": "HIGH"}
REASONS = "array<struct<code: string, title: string, severity: string>>"


def _reason(code: str, title: str, severity: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(title).alias("title"), F.lit(severity).alias("severity"))


def _distinct_reasons(c: Column) -> Column:
    """Each code once, in the order of their last places, with the title and severity of its first."""
    last = F.filter(c, lambda x, i: ~F.exists(F.slice(c, i + 2, F.size(c)), lambda y: y["code"] == x["code"]))
    return F.transform(last, lambda x: F.filter(c, lambda y: y["code"] == x["code"])[0])


def risk_policy(evidence: DataFrame) -> DataFrame:
    """evidence with band, risk_class, status, score, reasons, missing_signals and limitations, by a fixed order of evidence that is
    never averaged (score is null).

    evidence has critical_mismatches (array of field names), structured_available, structured_class and structured_reasons,
    image_available, image_class, image_score and image_reasons (arrays of codes: why a model is not available),
    fields_complete, verification_status, semantic_reasons and image_signals (arrays of code, title, severity) and
    corrected_fields (array). Nulls are empty lists and false. The first rule that holds sets the band:

    a critical field differs from the stored record; the structured model says FRAUDULENT; the image model says tampered at
    IMAGE_HIGH or more; the structured model has a class, unless that is the low one and fields are not complete; nothing.
    The rule's reasons come before the semantic and the image ones. A status is COMPLETED where a conclusion had both models,
    PARTIAL otherwise. A mismatch of a field that the policy does not name makes the row's status INPUT_INVALID, without a
    band and with empty lists."""
    none, no_reasons = F.array().cast("array<string>"), F.array().cast(REASONS)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    words = lambda c: F.coalesce(F.col(c), none)
    own = lambda c: F.coalesce(F.col(c).cast(REASONS), no_reasons)
    one = lambda when, v: F.when(when, F.array(v)).otherwise(F.array().cast("array<string>"))
    mismatches = words("critical_mismatches")
    mismatch_reasons = F.filter(
        F.array(*(F.when(F.array_contains(mismatches, f), _reason(f"REFERENCE_{f.upper()}_MISMATCH", title, "HIGH")) for f, title in CRITICAL_FIELDS.items())), lambda x: x.isNotNull()
    )
    cls = F.when(yes("structured_available"), F.col("structured_class"))
    class_reason = F.lit(None).cast("struct<code: string, title: string, severity: string>")
    for k, r in CLASS_REASONS.items():
        class_reason = F.when(cls == k, _reason(*r)).otherwise(class_reason)
    band_of = F.lit(None).cast("string")
    for k, b in CLASS_BANDS.items():
        band_of = F.when(cls == k, b).otherwise(band_of)
    tampered = yes("image_available") & F.coalesce((F.col("image_class") == "tampered") & (F.col("image_score") >= IMAGE_HIGH), F.lit(False))
    incomplete = (band_of == "low_risk") & ~yes("fields_complete")
    nothing = "CONCLUSIVE_MODEL_EVIDENCE_UNAVAILABLE"
    low_open = "CRITICAL_OCR_FIELDS_INCOMPLETE"
    rules = [  # condition, band, reasons, the signal that is missing
        (F.size(mismatches) > 0, F.lit("high_risk"), mismatch_reasons, None),
        (cls == "FRAUDULENT", F.lit("high_risk"), F.array(class_reason), None),
        (tampered, F.lit("high_risk"), F.array(_reason(*IMAGE_REASON)), None),
        (incomplete, F.lit("inconclusive"), F.array(_reason(*INSUFFICIENT)), low_open),
        (band_of.isNotNull(), band_of, F.array(class_reason), None),
        (F.lit(True), F.lit("inconclusive"), F.array(_reason(*INSUFFICIENT)), nothing),
    ]
    band, primary, missing = F.lit(None).cast("string"), no_reasons, F.lit(None).cast("string")
    for when, b, reasons, signal in reversed(rules):
        when = F.coalesce(when, F.lit(False))
        band, primary, missing = F.when(when, b).otherwise(band), F.when(when, reasons).otherwise(primary), F.when(when, F.lit(signal).cast("string")).otherwise(missing)
    invalid = F.exists(mismatches, lambda x: ~x.isin(list(CRITICAL_FIELDS)))
    unavailable = F.concat(F.when(~yes("image_available"), words("image_reasons")).otherwise(none), F.when(~yes("structured_available"), words("structured_reasons")).otherwise(none))
    open_ = F.col("band") == "inconclusive"
    signals = F.concat(
        one(F.col("__m").isNotNull(), F.col("__m")), one(open_ & ~yes("fields_complete"), F.lit(low_open)), one(open_ & F.coalesce(F.col("verification_status") == "UNVERIFIED", F.lit(False)), F.lit("REFERENCE_RECORD_UNAVAILABLE")), unavailable
    )
    limits = F.array_compact(
        F.array(
            F.when(F.col("verification_status") == "VERIFIED", "STORED_REFERENCE_MATCH_NOT_AUTHENTICITY"),
            F.when(F.size(own("image_signals")) > 0, "DETERMINISTIC_IMAGE_SUPPORTING_ONLY"),
            F.when(F.size(words("corrected_fields")) > 0, "CORRECTED_LOW_CONFIDENCE_FIELDS"),
        )
    )
    risk_class = F.lit(None).cast("string")
    for b, k in RISK_CLASSES.items():
        risk_class = F.when(F.col("band") == b, k).otherwise(risk_class)
    both = yes("image_available") & yes("structured_available")
    d = evidence.withColumns({"__x": invalid, "__m": missing, "__r": F.concat(primary, own("semantic_reasons"), own("image_signals"))})
    d = d.withColumn("band", F.when(~F.col("__x"), band))
    valid = lambda c, empty: F.when(F.col("__x"), empty).otherwise(c)
    return d.withColumns(
        {
            "risk_class": risk_class,
            "status": F.when(F.col("__x"), "INPUT_INVALID").when(both & ~open_, "COMPLETED").otherwise("PARTIAL"),
            "score": F.lit(None).cast("double"),
            "reasons": valid(_distinct_reasons(F.col("__r")), no_reasons),
            "missing_signals": valid(F.array_distinct(signals), none),
            "limitations": valid(limits, none),
        }
    ).drop("__x", "__m", "__r")


def evaluate_rules(facts: DataFrame, rules: DataFrame, review: float = 35, block: float = 70) -> DataFrame:
    """facts (id, fact) against rules (rule_code, fact, contribution): the sum of triggered contributions and its band.

    The rules' size decides whether they are broadcast."""
    hit = facts.join(rules, "fact").groupBy("id").agg(F.sum("contribution").alias("score"), F.array_join(F.array_sort(F.collect_set("rule_code")), ",").alias("rules"))
    return hit.withColumn("outcome", F.when(F.col("score") >= block, "BLOCK").when(F.col("score") >= review, "REVIEW").otherwise("PASS"))


def idempotent_replay(requests: DataFrame) -> DataFrame:
    """Each request (principal, scope, key, hash, seq) as FIRST, REPLAY, or CONFLICT where the first had another hash."""
    first = requests.groupBy("principal", "scope", "key").agg(F.min_by("hash", "seq").alias("first_hash"), F.min("seq").alias("first_seq"))
    d = requests.join(first, ["principal", "scope", "key"])
    return d.withColumn("outcome", F.when(F.col("seq") == F.col("first_seq"), "FIRST").when(F.col("hash") == F.col("first_hash"), "REPLAY").otherwise("CONFLICT")).drop("first_hash", "first_seq")


def binary_grid(scored: DataFrame) -> DataFrame:
    """(t, mean_f1, recall) for t from 0.05 to 0.95: the mean F1 of both classes. Rows are summed by how many t they reach first,
    so that 40 rows at most meet the 19 thresholds."""
    steps = [k / 100 for k in range(5, 100, 5)]
    reached = sum(((F.col("score") >= t).cast("int") for t in steps), F.lit(0))
    by = scored.groupBy(reached.alias("reached"), "label").agg(F.count("*").alias("n"))
    grid = scored.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(steps)], "k int, t double")
    d = by.crossJoin(F.broadcast(grid)).withColumn("hit", F.col("reached") >= F.col("k"))
    n = lambda label, hit: F.sum(F.when((F.col("label") == label) & (F.col("hit") == hit), F.col("n")).otherwise(0))
    c = d.groupBy("t").agg(n(1, True).alias("tp"), n(0, True).alias("fp"), n(1, False).alias("fn"), n(0, False).alias("tn"))
    f1 = lambda a: F.when(2 * F.col(a) + F.col("fp") + F.col("fn") > 0, 2 * F.col(a) / (2 * F.col(a) + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0))
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    return c.select("t", F.round((f1("tp") + f1("tn")) / 2, 8).alias("mean_f1"), F.round(recall, 8).alias("recall"))
