"""Reference rows, feature contracts, evidence signals, manifest rules and audit reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .references import canonical_phone, occurred_at
from .transactions import codes

# Domains of a manifest and of a registry.
SOURCE_TYPES = ["synthetic", "controlled_tamper", "real_authorised"]
SPLITS = ["train", "validation", "test"]
ANONYMISATION = ["anonymised", "not_applicable"]
MAX_AMOUNT = 999999999.99


def canonicalize_references(df: DataFrame) -> DataFrame:
    """Text columns of reference rows in canonical form, null where they are invalid, and errors (comma-joined codes by name).

    Texts but the phones are in NFKC form with single spaces first. Times are in one of six forms or in ISO form; names are
    sender_name and, where there is one, receiver_name."""
    names = [c for c in ("sender_name", "receiver_name") if c in df.columns]
    texts = ["provider_code", "transaction_reference", "amount", "currency", *names, "occurred_at", "transaction_status"]
    df = df.withColumns({c: clean_text(F.col(c)) for c in texts})
    provider = F.regexp_replace(F.regexp_replace(F.upper(F.trim("provider_code")), "[^A-Z0-9_]", "_"), "^_+|_+$", "")
    ref = F.upper(F.regexp_replace("transaction_reference", " ", ""))
    money = F.bround(F.regexp_replace("amount", "[^0-9.-]", "").try_cast("decimal(20,6)"), 2)

    def name(c: str) -> Column:
        n = F.regexp_replace(c, "^[ :-]+|[ :-]+$", "")
        return F.when(n.rlike("[A-Za-z]") & (F.length(n) <= 150), F.upper(n))

    d = df.withColumns(
        {
            "provider_code": F.when((provider != "") & (F.length(provider) <= 50), provider),
            "transaction_reference": F.when(ref.rlike("^[A-Z0-9][A-Z0-9._/-]{5,49}$"), ref),
            "amount": F.when((money >= 0) & (money <= MAX_AMOUNT), money.cast("decimal(18,2)")),
            "currency": F.nullif(F.upper(F.trim("currency")), F.lit("")), **{c: name(c) for c in names}, "sender_phone": canonical_phone(F.col("sender_phone")),
            "receiver_phone": canonical_phone(F.col("receiver_phone")), "occurred_at": occurred_at(F.col("occurred_at"))["at"],
            "transaction_status": F.when(F.upper(F.trim("transaction_status")).isin("SUCCESS", "COMPLETED"), "SUCCESSFUL").otherwise(F.upper(F.trim("transaction_status"))),
        }
    )
    need = ["amount", "currency", "occurred_at", "provider_code", "transaction_reference", "transaction_status"]
    return d.withColumn("errors", F.array_join(codes(**{f"{c.upper()}_INVALID": F.col(c).isNull() for c in need}), ","))


# The features of the evidence model in their order. Numbers: (name, minimum, maximum, whether null is allowed).
NUMERIC_FEATURES = [
    ("ocr_required_field_coverage", 0, 1, False),
    ("ocr_mean_confidence", 0, 1, False),
    ("ocr_min_critical_confidence", 0, 1, False),
    ("ocr_provider_confidence", 0, 1, False),
    ("critical_correction_count", 0, 20, False),
    ("total_correction_count", 0, 50, False),
    ("transaction_reference_valid", 0, 1, False),
    ("amount_valid", 0, 1, False),
    ("phone_valid", 0, 1, False),
    ("timestamp_valid", 0, 1, False),
    ("status_text_consistent", 0, 1, False),
    ("ocr_text_density", 0, 1, False),
    ("template_anchor_coverage", 0, 1, False),
    ("blur_variance", 0, 100000, False),
    ("contrast_stddev", 0, 255, False),
    ("aspect_ratio_deviation", 0, 5, False),
    ("crop_proximity", 0, 1, False),
    ("metadata_inconsistency_count", 0, 20, False),
    ("ela_mean", 0, 255, False),
    ("ela_p95", 0, 255, False),
    ("noise_regional_cv", 0, 10, False),
    ("text_baseline_deviation", 0, 2, False),
    ("text_size_cv", 0, 10, False),
    ("exact_duplicate_count", 0, 1000, False),
    ("nearest_phash_distance", 0, 64, True),
    ("cnn_tamper_probability", 0, 1, True),
    ("cnn_available", 0, 1, False),
    ("reference_candidate_found", 0, 1, False),
    ("amount_match", 0, 1, True),
    ("currency_match", 0, 1, True),
    ("phone_match", 0, 1, True),
    ("name_similarity", 0, 1, True),
    ("timestamp_difference_minutes", 0, 525600, True),
    ("reference_status_match", 0, 1, True),
    ("verification_mismatch_count", 0, 10, False),
    ("reused_reference_count", 0, 1000, False),
    ("nearest_phash_missing", 0, 1, False),
    ("cnn_probability_missing", 0, 1, False),
    ("reference_comparison_missing", 0, 1, False),
    ("name_similarity_missing", 0, 1, False),
    ("timestamp_difference_missing", 0, 1, False),
]
# The categories of the others, none of which may be null.
CATEGORICAL_FEATURES = {
    "provider_code": ["GENERIC_MOMO", "UNKNOWN", "OTHER_AUTHORISED"],
    "template_code": ["GENERIC_V1", "UNKNOWN", "OTHER_AUTHORISED"],
    "verification_status": ["VERIFIED", "UNVERIFIED", "MISMATCH"],
    "image_evidence_status": ["AVAILABLE", "PARTIAL", "UNAVAILABLE"],
    "ocr_engine_status": ["AVAILABLE", "DEGRADED", "UNAVAILABLE"],
}
# Columns that must not reach a model.
FORBIDDEN_FEATURES = [
    "final_case_decision", "final_risk_class", "label", "name", "phone", "raw_name", "raw_ocr_text", "raw_phone", "raw_reference", "reference", "reviewer_decision", "user_id",
]
_SPEC = "feature string, low double, high double, nullable boolean, categories array<string>"


def feature_contract(spark: SparkSession, numeric: list[tuple] = NUMERIC_FEATURES, categorical: dict[str, list[str]] = CATEGORICAL_FEATURES) -> DataFrame:
    """The contract as a table: a row for each feature, with categories where it is categorical."""
    rows = [(f, float(low), float(high), nullable, None) for f, low, high, nullable in numeric]
    return spark.createDataFrame(rows + [(f, None, None, False, c) for f, c in categorical.items()], _SPEC)


def check_feature_contract(df: DataFrame, key: str, contract: DataFrame | None = None, forbidden: list[str] = FORBIDDEN_FEATURES) -> DataFrame:
    """(key, feature, code) of what breaks a contract (feature_contract; the evidence model's, if none is given).

    A column that is forbidden, unknown or missing is a violation with a null key. Each value is a row that meets its feature's
    row of the contract: NULL_NOT_ALLOWED, NOT_NUMERIC (by the column's type, booleans too), NOT_FINITE, BELOW_MINIMUM,
    ABOVE_MAXIMUM, NOT_IN_CATEGORIES (another type than text too). The contract is a small table (its names are read)."""
    contract = feature_contract(df.sparkSession) if contract is None else contract
    names = [r["feature"] for r in contract.select("feature").collect()]
    kinds = dict(df.dtypes)
    number = lambda c: kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    columns = [c for c in df.columns if c != key]
    odd = [(c, "FORBIDDEN_FEATURE") for c in columns if c in forbidden] + [(c, "UNKNOWN_FEATURE") for c in columns if c not in names and c not in forbidden]
    odd += [(c, "MISSING_FEATURE") for c in names if c not in columns]
    value = lambda c: F.struct(
        F.lit(c).alias("feature"),
        (F.col(c).cast("double") if number(c) else F.lit(None).cast("double")).alias("number"),
        (F.col(c) if kinds[c] == "string" else F.lit(None).cast("string")).alias("word"),
        F.col(c).isNull().alias("null"),
        F.lit(number(c)).alias("numeric"),
    )
    given = [c for c in columns if c in names]
    long = df.select(key, F.explode(F.array(*map(value, given))).alias("x")).select(key, "x.*") if given else None
    schema = f"{key} {kinds[key]}, feature string, code string"
    out = df.sparkSession.createDataFrame([(None, c, code) for c, code in odd], schema)
    if long is None:
        return out
    x, categorical = F.col("number"), F.col("categories").isNotNull()
    code = (
        F.when(F.col("null"), F.when(~F.col("nullable"), "NULL_NOT_ALLOWED"))
        .when(categorical, F.when(~F.coalesce(F.array_contains("categories", F.col("word")), F.lit(False)), "NOT_IN_CATEGORIES"))
        .when(~F.col("numeric"), "NOT_NUMERIC")
        .when(F.isnan(x) | (F.abs(x) == float("inf")), "NOT_FINITE")
        .when(x < F.col("low"), "BELOW_MINIMUM")
        .when(x > F.col("high"), "ABOVE_MAXIMUM")
    )
    return long.join(F.broadcast(contract), "feature").select(key, "feature", code.alias("code")).where("code IS NOT NULL").unionByName(out)


def evidence_signals(df: DataFrame, key: str, thresholds: list[tuple[str, str, float, str]]) -> DataFrame:
    """(key, seq, code, status, severity, observed, threshold), one row for each of (code, column, threshold, severity).

    NOT_APPLICABLE where the measurement is null, TRIGGERED at or above the threshold, else OBSERVED."""

    def row(k: int, code: str, column: str, at: float, severity: str) -> Column:
        v = F.col(column).cast("double")
        hit = v >= at
        status = F.when(v.isNull(), "NOT_APPLICABLE").when(hit, "TRIGGERED").otherwise("OBSERVED")
        return F.struct(F.lit(k).alias("seq"), F.lit(code).alias("code"), status.alias("status"), F.when(hit, severity).otherwise("INFORMATIONAL").alias("severity"), v.alias("observed"), F.lit(at).alias("threshold"))

    return df.select(key, F.explode(F.array(*(row(k, *t) for k, t in enumerate(thresholds)))).alias("x")).select(key, "x.*")


def triggered_reasons(signals: DataFrame, key: str) -> DataFrame:
    """(key, reasons): the different triggered codes in the order of their first signal."""
    first = signals.where(F.col("status") == "TRIGGERED").groupBy(key, "code").agg(F.min("seq").alias("seq"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"])
    return first.groupBy(key).agg(F.array_join(in_order, ",").alias("reasons"))


def registry_blockers(registry: DataFrame, specs: DataFrame) -> DataFrame:
    """(dataset_id, blockers, eligible): what keeps each registered dataset from use, as what:state, sorted. A dataset without a
    specification is blocked."""
    d = registry.join(specs.select("dataset_id", F.col("status").alias("validation_spec_status")), "dataset_id", "left")
    said = lambda c: F.concat(F.lit(f"{c}:"), F.coalesce(c, F.lit("missing")))
    fine = {
        "acquisition_status": ~F.coalesce(F.col("acquisition_status") == "quarantined", F.lit(False)), "licence_status": F.col("licence_status").isin("verified", "not_applicable_private_consent"),
        "permission_status": F.col("permission_status") == "approved", "validation_spec_status": F.col("validation_spec_status") == "ready",
    }
    bad = F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), said(c)) for c, ok in fine.items()))))
    return d.select("dataset_id", F.array_join(bad, ",").alias("blockers"), (F.size(bad) == 0).alias("eligible"))


def registry_counts(blockers: DataFrame) -> DataFrame:
    """One row: registered datasets, eligible and blocked ones."""
    return blockers.agg(F.count("*").alias("sources"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("blocked"))


def manifest_rules(df: DataFrame, private: Column) -> DataFrame:
    """(sample_id, code), one row for each rule that a record breaks; private says that its notes hold an identifier."""
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    inside = lambda x, d: F.coalesce(c(x).isin(d), F.lit(False))
    made = inside("source_type", ["synthetic", "controlled_tamper"])
    real, tamper = inside("source_type", ["real_authorised"]), inside("source_type", ["controlled_tamper"])
    personal = F.coalesce("contains_personal_data", F.lit(False))
    ops = F.coalesce("operations", F.array().cast("array<string>"))
    parsed = F.from_json("tamper_metadata", "operations array<struct<name:string>>")
    described = F.coalesce(F.transform(parsed["operations"], lambda x: x["name"]), F.array().cast("array<string>"))
    valid_json = ~blank("tamper_metadata") & F.try_parse_json("tamper_metadata").isNotNull()
    lineage = ~blank("parent_sample_id") | (F.size(ops) > 0) | ~blank("tamper_metadata")
    broken = codes(
        missing_identity=c("sample_id").isNull() | blank("group_id"), invalid_source_type=~inside("source_type", SOURCE_TYPES), invalid_label=~inside("label", [0, 1]),
        invalid_split=~inside("split", SPLITS), invalid_anonymisation=~inside("anonymisation_status", ANONYMISATION), missing_permission=blank("permission"),
        invalid_location=blank("relative_path") == blank("private_object_id"), invalid_sha256=~F.coalesce(c("sha").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        synthetic_personal_data=made & personal, synthetic_anonymisation_status=made & ~inside("anonymisation_status", ["not_applicable"]), missing_generation_seed=made & c("seed").isNull(),
        real_data_not_anonymised=real & personal & ~inside("anonymisation_status", ["anonymised"]), real_data_in_repository_path=real & ~blank("relative_path"),
        incomplete_tamper_provenance=tamper & (blank("parent_sample_id") | (F.size(ops) == 0)), invalid_tamper_metadata=tamper & ~valid_json,
        tamper_metadata_mismatch=tamper & valid_json & (F.array_sort(F.array_distinct(ops)) != F.array_sort(F.array_distinct(described))),
        unexpected_tamper_provenance=~tamper & lineage, augmentation_outside_train=F.exists(ops, lambda o: o.startswith("augment:")) & ~inside("split", ["train"]),
        unapproved_private_identifier=F.coalesce(private, F.lit(False)) & ~personal,
    )
    return df.select("sample_id", F.explode(broken).alias("code"))


def owner_scope(df: DataFrame, owner: str, value: object) -> DataFrame:
    return df.where(F.col(owner) == F.lit(value))


def audit_search(events: DataFrame, since: str | None = None, until: str | None = None, **equal: object) -> DataFrame:
    """Audit events by any of actor, action, target, outcome and so on, at or after since and before until."""
    out = events
    for c, v in equal.items():
        out = out if v is None else out.where(F.col(c) == F.lit(v))
    out = out if since is None else out.where(F.col("at") >= F.lit(since).cast("timestamp"))
    return out if until is None else out.where(F.col("at") < F.lit(until).cast("timestamp"))


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def assert_feature_columns(df: DataFrame, expected: list[str], forbidden: list[str]) -> DataFrame:
    """df itself, or ValueError where its columns repeat, are forbidden or are not those expected in their order."""
    if len(set(df.columns)) != len(df.columns) or set(df.columns) & set(forbidden) or df.columns != expected:
        raise ValueError(f"the columns are {df.columns}, not {expected}")
    return df


def split_intersections(df: DataFrame) -> DataFrame:
    """(a, b, group_id): groups that two splits, a before b, share."""
    s = df.select("split", "group_id").distinct()
    x, y = s.withColumnRenamed("split", "a"), s.withColumnRenamed("split", "b")
    return x.join(y, "group_id").where("a < b").select("a", "b", "group_id")


def load_development(df: DataFrame, open_splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Rows of the open splits only; no row of another split passes."""
    return df.where(F.col("split").isin(*open_splits))
