"""Queries of the reference, contract, evidence, manifest and audit operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages, references
from ..operators import records as r
from .catalog import query

# Columns that both engines derive by the same text.
_RAW = [
    "ref_id",
    "' ' || lower(replace(provider_code, '_', ' ')) || CASE WHEN ref_id % 53 = 0 THEN '-' ELSE '' END AS provider_code",
    "lower(replace(transaction_reference, '-', ' -')) || CASE WHEN ref_id % 47 = 0 THEN '!' ELSE '' END AS transaction_reference",
    "CASE WHEN ref_id % 61 = 0 THEN 'none' WHEN ref_id % 59 = 0 THEN '-' ELSE 'GHS ' END || CAST(amount AS STRING) AS amount",
    "CASE WHEN ref_id % 43 = 0 THEN ' ' ELSE 'ghs ' END AS currency",
    "': ' || lower(replace(sender_name, ' ', '   ')) || ' -' AS sender_name",
    "CASE ref_id % 4 WHEN 0 THEN '0' || substr(sender_phone, 5) WHEN 1 THEN substr(sender_phone, 5) WHEN 2 THEN substr(sender_phone, 2) ELSE '12' END AS sender_phone",
    "receiver_phone",
    # Each of the six forms, two ISO forms, and two that are none.
    "CASE ref_id % 10 "
    "WHEN 0 THEN {y} || '-' || {m} || '-' || {d} || '  10:20:09' WHEN 1 THEN {y} || '-' || {m} || '-' || {d} || ' 10:20' "
    "WHEN 2 THEN {d} || '/' || {m} || '/' || {y} || ' 10:20:09' WHEN 3 THEN {d} || '/' || {m} || '/' || {y} || '  10:20' "
    "WHEN 4 THEN {d} || '-' || {m} || '-' || {y} || ' 10:20:09' WHEN 5 THEN {d} || '-' || {m} || '-' || {y} || ' 10:20' "
    "WHEN 6 THEN {y} || '-' || {m} || '-' || {d} || 'T10:20:30Z' WHEN 7 THEN {y} || '-' || {m} || '-' || {d} || 'T10:20:30+02:00' "
    "WHEN 8 THEN '31/31/2001 10:20' ELSE {d} || '/' || {m} || '-' || {y} || ' 10:20' END AS occurred_at".format(
        y="CAST(year(occurred_at) AS STRING)", m="lpad(CAST(month(occurred_at) AS STRING), 2, '0')", d="lpad(CAST(day(occurred_at) AS STRING), 2, '0')"
    ),
    "': ' || lower(receiver_name) || ' : ' AS receiver_name",
    "lower(transaction_status) AS transaction_status",
]
_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"


def _phone(c: str) -> str:
    d = _DIGITS.format(c)
    return f"CASE WHEN regexp_matches({d}, '^233[0-9]{{9}}$') THEN '+' || {d} WHEN regexp_matches({d}, '^0[0-9]{{9}}$') THEN '+233' || substr({d}, 2) WHEN regexp_matches({d}, '^[25][0-9]{{8}}$') THEN '+233' || {d} END"


_CANON = (
    f"+ w AS (SELECT {', '.join(_RAW)} FROM refs), k AS (SELECT ref_id, nullif(regexp_replace(regexp_replace(upper(trim(provider_code)), '[^A-Z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), '') AS provider_code, upper(replace(transaction_reference, ' ', '')) AS rr, CASE WHEN regexp_matches(rr, '^[A-Z0-9][A-Z0-9._/-]{{5,49}}$') THEN rr END AS transaction_reference,"
    + " TRY_CAST(regexp_replace(amount, '[^0-9.-]', '', 'g') AS DECIMAL(18,2)) AS m, CASE WHEN m >= 0 THEN m END AS amount, nullif(upper(trim(currency)), '') AS currency, upper(regexp_replace(trim(regexp_replace(sender_name, ' +', ' ', 'g')), '^[ :-]+|[ :-]+$', '', 'g')) AS sender_name,"
    + f" {_phone('sender_phone')} AS sender_phone, {_phone('receiver_phone')} AS receiver_phone, coalesce(try_strptime(regexp_replace(occurred_at, ' +', ' ', 'g'), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%d-%m-%Y %H:%M:%S', '%d-%m-%Y %H:%M', '%Y-%m-%dT%H:%M:%SZ']), try_strptime(occurred_at, '%Y-%m-%dT%H:%M:%S+02:00') - INTERVAL 2 HOUR) AS occurred_at, upper(regexp_replace(trim(receiver_name), '^[ :-]+|[ :-]+$', '', 'g')) AS receiver_name, CASE upper(transaction_status) WHEN 'SUCCESS' THEN 'SUCCESSFUL' ELSE upper(transaction_status) END AS transaction_status FROM w)"
)
_REF_COLS = ["ref_id", "provider_code", "transaction_reference", "amount", "currency", "sender_name", "sender_phone", "receiver_name", "receiver_phone", "transaction_status"]
_NEED = ["amount", "currency", "occurred_at", "provider_code", "transaction_reference", "transaction_status"]


@query(f"{_CANON} SELECT {', '.join(_REF_COLS)}, epoch(occurred_at)::BIGINT AS occurred_s, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c.upper()}_INVALID' END" for c in _NEED) + ") AS errors FROM k", "refs")
def p7_canonicalize_references(refs):
    return r.canonicalize_references(refs.selectExpr(*_RAW)).select(*_REF_COLS, F.unix_timestamp("occurred_at").alias("occurred_s"), "errors")


_SOURCE = "CASE WHEN ref_id % 83 = 0 THEN repeat('x', 151) ELSE 'SYS-' || CAST(ref_id DIV 100 AS STRING) END AS source_system_id"
_ERRORS = (
    f"{_CANON}, c AS (SELECT k.*, {_SOURCE.replace('ref_id DIV 100', 'ref_id // 100')}, w.sender_phone AS rs, w.receiver_phone AS rv, w.occurred_at AS ro FROM k JOIN w USING (ref_id)),"
    + " d AS (SELECT ref_id, row_number() OVER (PARTITION BY provider_code, transaction_reference, source_system_id ORDER BY ref_id) AS n FROM c WHERE provider_code IS NOT NULL AND transaction_reference IS NOT NULL), e AS ("
    + " UNION ALL ".join(
        f"SELECT ref_id, '{f}' AS field, '{code}' AS code, '{text}' AS message FROM {src} WHERE {bad}"
        for f, code, text, src, bad in [
            *((c, code, f"Invalid {c}.", "c", f"{c} IS NULL") for c, code in [("provider_code", "INVALID_PROVIDER"), ("transaction_reference", "INVALID_REFERENCE"), ("amount", "INVALID_DECIMAL"), ("currency", "INVALID_CURRENCY")]),
            *((c, "INVALID_GHANA_PHONE", "Use a Ghanaian phone format.", "c", f"coalesce({o}, '') <> '' AND {c} IS NULL") for c, o in [("sender_phone", "rs"), ("receiver_phone", "rv")]),
            ("occurred_at", "INVALID_TIMESTAMP", "Use an ISO or supported Ghana date/time format.", "c", "ro <> '' AND occurred_at IS NULL"),
            ("source_system_id", "SOURCE_SYSTEM_ID_TOO_LONG", "Source-system identifiers must be 150 characters or fewer.", "c", "length(source_system_id) > 150"),
            ("transaction_reference", "DUPLICATE_ROW", "This provider/reference/source combination is repeated in the file.", "d", "n > 1"),
        ]
    )
    + ")"
)


def _errors(refs):
    raw = refs.selectExpr(*_RAW, _SOURCE)
    return references.import_errors(raw, r.canonicalize_references(raw), "ref_id", "ref_id")


@query(f"{_ERRORS} SELECT * FROM e", "refs")
def p8_import_errors(refs):
    return _errors(refs)


@query(f"{_ERRORS}, n AS (SELECT (SELECT count(*) FROM refs) AS total, (SELECT count(DISTINCT ref_id) FROM e) AS invalid) SELECT total, invalid, total - invalid AS valid, CASE WHEN invalid = 0 THEN 'VALIDATED' ELSE 'VALIDATED_WITH_ERRORS' END AS status FROM n", "refs")
def a22_import_batch_summary(refs):
    return references.import_batch_summary(refs, _errors(refs))


def _feature(k: int, name: str, low: float, high: float) -> str:
    """A feature of an event within its bounds, and now and then null, no number, or beyond them; the same text for both engines."""
    share = f"CAST((CAST(floor(value * 100) AS BIGINT) * {k + 3} + event_id) % 1001 AS DOUBLE) / 1000"
    odd = f"WHEN event_id % 97 = {k} THEN NULL WHEN event_id % 89 = {k} THEN {high} + 0.5 WHEN event_id % 83 = {k} THEN {low} - 0.5 WHEN event_id % 79 = {k} THEN CAST('NaN' AS DOUBLE)"
    return f"CASE {odd} ELSE {low} + {high - low} * {share} END AS {name}"


def _category(k: int, name: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE WHEN event_id % 71 = {k} THEN NULL WHEN event_id % 67 = {k} THEN 'OTHER' ELSE CASE event_id % {len(values)} {cases} END END AS {name}"


_FEATURES = [_feature(k, f, lo, hi) for k, (f, lo, hi, _) in enumerate(r.NUMERIC_FEATURES)] + [_category(k, f, c) for k, (f, c) in enumerate(r.CATEGORICAL_FEATURES.items())]
_BROKEN = [
    f"SELECT event_id, '{f}' AS feature, CASE WHEN {f} IS NULL THEN {'NULL' if n else chr(39) + 'NULL_NOT_ALLOWED' + chr(39)} WHEN isnan({f}) THEN 'NOT_FINITE' WHEN {f} < {lo} THEN 'BELOW_MINIMUM' WHEN {f} > {hi} THEN 'ABOVE_MAXIMUM' END AS code FROM f"
    for f, lo, hi, n in r.NUMERIC_FEATURES
] + [
    f"SELECT event_id, '{f}', CASE WHEN {f} IS NULL THEN 'NULL_NOT_ALLOWED' WHEN {f} NOT IN ({', '.join(repr(x) for x in c)}) THEN 'NOT_IN_CATEGORIES' END FROM f" for f, c in r.CATEGORICAL_FEATURES.items()
]


@query(
    f"WITH f AS MATERIALIZED (SELECT event_id, {', '.join(_FEATURES)} FROM events), v AS ({' UNION ALL '.join(_BROKEN)})"
    " SELECT * FROM v WHERE code IS NOT NULL UNION ALL SELECT NULL, 'phone', 'FORBIDDEN_FEATURE' UNION ALL SELECT NULL, 'remark', 'UNKNOWN_FEATURE'",
    "events",
)
def p10_feature_contract(events):
    return r.check_feature_contract(events.selectExpr("event_id", *_FEATURES, "'024' AS phone", "'x' AS remark"), "event_id")


_THRESHOLDS = [("BLURRED", "blur", 0.6, "MEDIUM"), ("ODD_ASPECT_RATIO", "aspect_ratio", 3.0, "LOW"), ("DUPLICATE_RECEIPT", "duplicates", 2.0, "HIGH"), ("METADATA_CONFLICT", "metadata_conflict", 1.0, "MEDIUM"), ("BLURRED", "metadata_conflict", 2.0, "LOW")]
_SIGNALS = "+ s AS (" + " UNION ALL ".join(f"SELECT id, {k} AS seq, '{c}' AS code, CASE WHEN {m} IS NULL THEN 'NOT_APPLICABLE' WHEN {m} >= {t} THEN 'TRIGGERED' ELSE 'OBSERVED' END AS status, CASE WHEN {m} >= {t} THEN '{v}' ELSE 'INFORMATIONAL' END AS severity, {m} AS observed, {t}::DOUBLE AS threshold FROM measures" for k, (c, m, t, v) in enumerate(_THRESHOLDS)) + ")"


@query(f"{_SIGNALS} SELECT * FROM s", "measures")
def p15_evidence_signals(measures):
    return r.evidence_signals(measures, "id", _THRESHOLDS)


@query(f"{_SIGNALS} SELECT id, string_agg(code, ',' ORDER BY f) AS reasons FROM (SELECT id, code, min(seq) AS f FROM s WHERE status = 'TRIGGERED' GROUP BY ALL) GROUP BY id", "measures")
def p16_triggered_reasons(measures):
    return r.triggered_reasons(r.evidence_signals(measures, "id", _THRESHOLDS), "id")


_REGISTRY = ["c_custkey AS dataset_id", "CASE WHEN c_custkey % 3 = 0 THEN 'approved' WHEN c_custkey % 3 = 1 THEN 'pending' END AS permission_status", "CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE 'verified' END AS licence_status", "CASE WHEN c_custkey % 7 = 0 THEN 'quarantined' ELSE 'open' END AS acquisition_status"]


_BLOCKED = (
    f"WITH g AS (SELECT {', '.join(_REGISTRY)} FROM customer), s AS (SELECT s_suppkey AS dataset_id, CASE WHEN s_suppkey % 5 = 0 THEN 'draft' ELSE 'ready' END AS status FROM supplier),"
    " b AS (SELECT g.dataset_id, concat_ws(',', CASE WHEN acquisition_status = 'quarantined' THEN 'acquisition_status:quarantined' END, CASE WHEN licence_status <> 'verified' THEN 'licence_status:' || licence_status END,"
    " CASE WHEN permission_status IS DISTINCT FROM 'approved' THEN 'permission_status:' || coalesce(permission_status, 'missing') END, CASE WHEN status IS DISTINCT FROM 'ready' THEN 'validation_spec_status:' || coalesce(status, 'missing') END) AS blockers FROM g LEFT JOIN s ON g.dataset_id = s.dataset_id)"
)


def _blocked(customer, supplier):
    return r.registry_blockers(customer.selectExpr(*_REGISTRY), supplier.selectExpr("s_suppkey AS dataset_id", "CASE WHEN s_suppkey % 5 = 0 THEN 'draft' ELSE 'ready' END AS status"))


@query(f"{_BLOCKED} SELECT dataset_id, blockers, blockers = '' AS eligible FROM b", "customer", "supplier")
def a14_registry_blockers(customer, supplier):
    return _blocked(customer, supplier)


@query(f"{_BLOCKED} SELECT count(*) AS sources, count_if(blockers = '')::BIGINT AS eligible, count_if(blockers <> '')::BIGINT AS blocked FROM b", "customer", "supplier")
def a14_registry_counts(customer, supplier):
    return r.registry_counts(_blocked(customer, supplier))


_MAN = [
    "CAST(sample_id AS STRING) AS sample_id", "CASE WHEN sample_id % 71 = 0 THEN '' ELSE group_id END AS group_id",
    "CASE sample_id % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'controlled_tamper' WHEN 2 THEN 'real_authorised' ELSE 'other' END AS source_type",
    "CASE WHEN sample_id % 67 = 0 THEN 9 ELSE label END AS label", "CASE WHEN sample_id % 41 = 0 THEN 'spare' ELSE split END AS split", "sample_id % 6 = 0 AS contains_personal_data",
    "CASE sample_id % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'anonymised' ELSE 'not_applicable' END AS anonymisation_status", "CASE WHEN sample_id % 13 <> 0 THEN 'CONSENT' END AS permission",
    "CASE WHEN sample_id % 3 = 0 THEN 'a/b.png' END AS relative_path", "CASE WHEN sample_id % 7 > 1 THEN 'obj' END AS private_object_id", "CASE WHEN sample_id % 31 = 0 THEN 'ABC' ELSE sha END AS sha",
    "CASE WHEN sample_id % 11 <> 0 THEN 7 END AS seed", "CASE WHEN sample_id % 9 <> 0 THEN 'p' ELSE '' END AS parent_sample_id",
    "CASE sample_id % 10 WHEN 1 THEN '{\"operations\": [{\"name\": \"crop\"}]}' WHEN 3 THEN 'not json' WHEN 5 THEN '{\"operations\": [{\"name\": \"augment:blur\"}, {\"name\": \"crop\"}]}' WHEN 7 THEN '' ELSE '{}' END AS tamper_metadata",
    "CASE sample_id % 8 WHEN 1 THEN 'crop' WHEN 5 THEN 'crop|augment:blur' ELSE '' END AS ops", "CASE WHEN sample_id % 17 = 0 THEN 'mail x@y.org' ELSE '' END AS notes",
]
_MADE, _REAL, _TAMPER = "source_type IN ('synthetic', 'controlled_tamper')", "source_type = 'real_authorised'", "source_type = 'controlled_tamper'"
_RULES = {
    "missing_identity": "group_id = ''", "invalid_source_type": "source_type = 'other'", "invalid_label": "label = 9", "invalid_split": "split = 'spare'", "invalid_anonymisation": "anonymisation_status = 'raw'", "missing_permission": "permission IS NULL",
    "invalid_location": "(relative_path IS NULL) = (private_object_id IS NULL)", "invalid_sha256": "sha = 'ABC'", "synthetic_personal_data": f"{_MADE} AND contains_personal_data", "synthetic_anonymisation_status": f"{_MADE} AND anonymisation_status <> 'not_applicable'",
    "missing_generation_seed": f"{_MADE} AND seed IS NULL", "real_data_not_anonymised": f"{_REAL} AND contains_personal_data AND anonymisation_status <> 'anonymised'", "real_data_in_repository_path": f"{_REAL} AND relative_path IS NOT NULL",
    "incomplete_tamper_provenance": f"{_TAMPER} AND (parent_sample_id = '' OR ops = '')", "invalid_tamper_metadata": f"{_TAMPER} AND NOT json_valid(tamper_metadata)",
    "tamper_metadata_mismatch": f"{_TAMPER} AND json_valid(tamper_metadata) AND list_sort(list_filter(string_split(ops, '|'), lambda v: v <> '')) <> list_sort(coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(tamper_metadata) THEN tamper_metadata END, '$.operations[*].name') AS VARCHAR[]), []))",
    "unexpected_tamper_provenance": f"NOT ({_TAMPER}) AND (parent_sample_id <> '' OR ops <> '' OR tamper_metadata <> '')", "augmentation_outside_train": "contains(ops, 'augment:') AND split <> 'train'", "unapproved_private_identifier": "notes <> '' AND NOT contains_personal_data",
}


@query(f"+ m AS (SELECT {', '.join(_MAN)} FROM manifest) " + " UNION ALL ".join(f"SELECT sample_id, '{k}' AS code FROM m WHERE {v}" for k, v in _RULES.items()), "manifest")
def a17_manifest_rules(manifest):
    m = manifest.selectExpr(*_MAN).withColumn("operations", F.array_remove(F.split("ops", r"\|"), ""))
    return r.manifest_rules(m, messages.identifier_categories(F.col("notes")) != "")


@query("SELECT run_id, transaction_id, status FROM runs WHERE transaction_id = 7", "runs")
def f5_owner_scope(runs):
    return r.owner_scope(runs, "transaction_id", 7).select("run_id", "transaction_id", "status")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'", "events")
def f6_audit_search(events):
    log = events.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("action"), F.col("user_id").alias("actor"))
    return r.audit_search(log, "2024-01-10", "2024-01-20", action="click", actor=None).select("event_id")


@query("SELECT id, CAST(blur IS NULL AS INT) AS blur_missing, CAST(aspect_ratio IS NULL AS INT) AS aspect_ratio_missing FROM measures", "measures")
def p14_missing_flags(measures):
    return r.missing_flags(measures, ["blur", "aspect_ratio"]).select("id", "blur_missing", "aspect_ratio_missing")


@query("+ s AS (SELECT DISTINCT split, group_id FROM manifest) SELECT x.split AS a, y.split AS b, x.group_id AS group_id FROM s x JOIN s y ON x.group_id = y.group_id AND x.split < y.split", "manifest")
def d2_split_intersections(manifest):
    return r.split_intersections(manifest)


@query("SELECT sample_id, split FROM manifest WHERE split IN ('train', 'validation')", "manifest")
def s8_load_development(manifest):
    return r.load_development(manifest).select("sample_id", "split")
