"""Queries of the corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpora as c
from ..operators import messages, references
from .catalog import _CUES, SQL, _template, query


@query(None, "msgs")
def m2_numbered_placeholders(msgs):
    d = c.numbered_placeholders(msgs.select("record_id", "text"))
    return d.select("record_id", F.sha2("clean", 256).alias("clean_sha256"), F.size("fields").alias("n_fields"), "leaks")


_VALUES = ["'SHOP ' || CAST(record_id % 97 AS STRING)", "'SHOP'", "CASE WHEN record_id % 9 = 0 THEN 'never found' ELSE 'Payment' END"]


@query(
    f"+ v AS (SELECT record_id, text, {', '.join(f'{v} AS v{i}' for i, v in enumerate(_VALUES))} FROM msgs), m AS (SELECT *, CASE WHEN length(v0) >= length(v2) THEN replace(replace(replace(text, v0, '[MASKED]'), v2, '[MASKED]'), v1, '[MASKED]') ELSE replace(replace(replace(text, v2, '[MASKED]'), v0, '[MASKED]'), v1, '[MASKED]') END AS clean FROM v) SELECT record_id, sha256(clean) AS clean_sha256, CASE WHEN NOT contains(text, v2) THEN 'VALUE_MISSING' ELSE '' END AS codes FROM m",
    "msgs",
)
def m3_mask_known_fields(msgs):
    d = msgs.selectExpr("record_id", "text", f"array({', '.join(_VALUES)}) AS values")
    return c.mask_known_fields(d, "text", "values", "record_id").select("record_id", F.sha2("clean", 256).alias("clean_sha256"), "codes")


_SMS = ["CASE user_id % 4 WHEN 0 THEN ' MobileMoney' WHEN 1 THEN 'mobilemoney' WHEN 2 THEN 'T-CASH' ELSE 'SPAM' END AS address", "event_type || ' ' || props AS body", "CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END AS type", "CAST(event_id % 500 AS BIGINT) * 60000 + 1700000000000 AS date"]
_SMS_SQL = f"WITH s AS (SELECT {', '.join(_SMS)} FROM events), k AS (SELECT *, CASE lower(trim(address)) WHEN 'mobilemoney' THEN 'MTN_MOMO' WHEN 't-cash' THEN 'TELECEL_CASH' END AS p FROM s) "


@query(_SMS_SQL + "SELECT sha256(p || chr(31) || CAST(date AS VARCHAR) || chr(31) || body) AS identity, p AS provider_family, min(date) // 1000 AS sent_s, min(body) AS body, count(*) AS copies FROM k WHERE p IS NOT NULL AND type = 1 GROUP BY 1, 2", "events")
def m10_normalize_sms(events):
    return _sms(events)[0].select("identity", "provider_family", F.unix_timestamp("sent_at_utc").alias("sent_s"), "body", "copies")


@query(_SMS_SQL + "SELECT count(*) FILTER (WHERE p IS NULL) AS unknown_sender, count(*) FILTER (WHERE p IS NOT NULL AND type <> 1) AS not_incoming, count(*) FILTER (WHERE p IS NOT NULL AND type = 1) AS kept FROM k", "events")
def m10_sms_counts(events):
    return _sms(events)[1]


def _sms(events):
    return c.normalize_sms(events.selectExpr(*_SMS), {"MobileMoney": "MTN_MOMO", "T-Cash": "TELECEL_CASH"})


_KINDS = dict(messages.SENSITIVE)
_NUMBER = _KINDS["PHONE"].replace(r"(?<!\d)", "(?:^|[^0-9])").replace(r"(?!\d)", "(?:[^0-9]|$)")


@query(
    f"+ a AS (SELECT *, regexp_replace(text, '{_KINDS['URL']}', '[URL]', 'g') AS t FROM msgs WHERE trim(text) <> ''), b AS (SELECT *, regexp_replace(t, '{_KINDS['EMAIL']}', '[EMAIL]', 'g') AS u FROM a)"
    " SELECT 'MSG-' || upper(substr(sha256('src:' || CAST(record_id AS VARCHAR)), 1, 16)) AS message_id,"
    " CASE WHEN regexp_matches(sender, '^[0-9]{3,6}$') THEN 'shortcode' WHEN regexp_matches(sender, '^\\+?[0-9]{9,15}$') THEN 'phone' WHEN regexp_matches(sender, '[A-Za-z]') THEN 'alphanumeric' ELSE 'unknown' END AS sender_kind,"
    f" len(regexp_extract_all(text, '{_KINDS['URL']}')) AS n_url, len(regexp_extract_all(t, '{_KINDS['EMAIL']}')) AS n_email, len(regexp_extract_all(u, '{_NUMBER}')) AS n_phone, len(regexp_extract_all(u, '{_KINDS['MONEY']}')) AS n_money FROM b",
    "msgs",
)
def m12_index_messages(msgs):
    """The fifth count, of references, needs a pattern that looks ahead: it is in m1_tokenize_sensitive."""
    return c.index_messages(msgs, "src", "record_id").select("message_id", "sender_kind", "n_url", "n_email", "n_phone", "n_money")


_MARKED = ["*", "CASE WHEN record_id % 23 = 0 THEN 'MMS' WHEN record_id % 29 <> 0 THEN 'SMS' END AS service", "CASE WHEN record_id % 31 = 0 THEN 'other' ELSE 'owner_export' END AS source_provenance"]
_OK = "lower(trim(sender)) IN ('mobilemoney', '4455') AND incoming AND service = 'SMS' AND source_provenance = 'owner_export'"


@query(f"SELECT CASE WHEN {_OK} THEN 'authentic' ELSE 'quarantined' END AS side, count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids FROM (SELECT {', '.join(_MARKED)} FROM msgs) GROUP BY 1", "msgs")
def f4_authenticity_boundary(msgs):
    good, bad = c.authenticity_boundary(msgs.selectExpr(*_MARKED), ["MOBILEMONEY", "4455"], "SMS", "owner_export")
    both = good.withColumn("side", F.lit("authentic")).unionByName(bad.withColumn("side", F.lit("quarantined")))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.sum("record_id").alias("ids"))


_FLOW = ["sample_id", "CASE sample_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'approved_with_edits' ELSE 'rejected' END AS workflow_state", "sample_id % 4 <> 0 AS training_eligible", "CASE WHEN sample_id % 7 <> 0 THEN sha END AS working_sha256"]


@query(f"+ f AS (SELECT {', '.join(_FLOW)} FROM manifest) SELECT sample_id, working_sha256 IS NOT NULL AS usable FROM f WHERE workflow_state <> 'rejected' AND training_eligible", "manifest")
def f3_eligible_for_training(manifest):
    good, bad = c.eligible_for_training(manifest.selectExpr(*_FLOW))
    return good.select("sample_id", F.lit(True).alias("usable")).unionByName(bad.select("sample_id", F.lit(False).alias("usable")))


_DEC = "SELECT record_id, 'approve' AS decision, CASE WHEN record_id % 23 = 0 THEN 'r1' ELSE 'r2' END AS reviewer FROM msgs WHERE record_id % 19 <> 0 UNION ALL SELECT record_id, 'reject', 'r3' FROM msgs WHERE record_id % 29 = 0 UNION ALL SELECT record_id + 100000000, 'approve', 'r2' FROM msgs WHERE record_id % 31 = 0"


@query(
    f"+ d AS ({_DEC}), o AS (SELECT record_id, count(*) AS n, min(reviewer) AS s FROM d GROUP BY 1), j AS (SELECT coalesce(m.record_id, o.record_id) AS record_id, m.record_id IS NULL AS unknown, n, s FROM msgs m FULL JOIN o ON m.record_id = o.record_id) SELECT record_id, 'DECIDED_TWICE' AS code FROM j WHERE n > 1 UNION ALL SELECT record_id, 'SAME_REVIEWER' FROM j WHERE s = 'r1' AND NOT unknown UNION ALL SELECT record_id, 'UNDECIDED' FROM j WHERE n IS NULL UNION ALL SELECT record_id, 'UNKNOWN_ID' FROM j WHERE unknown",
    "msgs",
)
def j14_review_violations(msgs):
    return c.apply_review_decisions(msgs.select("record_id", F.lit("r1").alias("first_reviewer")), msgs.sparkSession.sql(_DEC.replace("FROM msgs", "FROM {m}"), m=msgs), "record_id")[1]


@query(
    "+ i AS (SELECT record_id FROM msgs WHERE record_id % 17 <> 0 UNION ALL SELECT record_id FROM msgs WHERE record_id % 37 = 0 UNION ALL SELECT record_id + 100000000 FROM msgs WHERE record_id % 41 = 0), n AS (SELECT record_id, count(*) AS n FROM i GROUP BY 1) SELECT record_id, CASE WHEN n IS NULL THEN 'INDEX_MISSING' WHEN n > 1 THEN 'INDEX_REPEATED' ELSE 'SOURCE_MISSING' END AS code FROM (SELECT coalesce(m.record_id, n.record_id) AS record_id, n, m.record_id IS NULL AS x FROM msgs m FULL JOIN n ON m.record_id = n.record_id) WHERE n IS NULL OR n > 1 OR x",
    "msgs",
)
def j15_index_violations(msgs):
    m = msgs.select("record_id")
    i = m.where("record_id % 17 <> 0").unionByName(m.where("record_id % 37 = 0")).unionByName(m.where("record_id % 41 = 0").selectExpr("record_id + 100000000 AS record_id"))
    return c.attach_index(m, i, "record_id")[1]


_NOTED = "CASE sample_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' WHEN 2 THEN 'approved' ELSE 'rejected' END AS annotation_state"


@query(f"SELECT annotation_state, CASE WHEN annotation_state = 'approved' THEN label END AS label, count(*) AS n FROM (SELECT label, {_NOTED} FROM manifest) GROUP BY ALL", "manifest")
def a15_annotation_report(manifest):
    return c.annotation_report(manifest.selectExpr("label", _NOTED))


_TRIAGE = SQL["j20_intake_triage"]


@query(None, "hashes")
def a15_state_report(hashes):
    from ..operators import governance

    return c.state_report(governance.intake_triage(hashes, hashes.where("id % 50 = 7"), references.near_counts(hashes, 6)))


SQL["a15_state_report"] = f"SELECT count(*) AS n, count(*) FILTER (WHERE starts_with(state, 'needs_')) AS pending, count(*) FILTER (WHERE state = 'exact_duplicate') AS exact, count(*) FILTER (WHERE state = 'near_duplicate') AS near, count(*) FILTER (WHERE state = 'withdrawn') AS withdrawn FROM ({_TRIAGE})"


@query(
    f"+ d AS (SELECT text, provider_family, regexp_matches(text, '{messages.SECRET}') AS x, {_CUES} AS q, {_template('text')} AS g FROM msgs) SELECT count(*) AS raw, count(*) FILTER (WHERE x) AS excluded, count(DISTINCT lower(text)) FILTER (WHERE NOT x) AS deduplicated, count(DISTINCT g) FILTER (WHERE NOT x) AS template_groups, count(DISTINCT provider_family) AS providers, count(*) FILTER (WHERE NOT x AND q) AS confirmations FROM d",
    "msgs",
)
def a16_corpus_report(msgs):
    t = F.col("text")
    return c.corpus_report(msgs, messages.has_secret(t), messages.message_category(t), messages.template_group(t))


# Groups of the split queries: forty by text hash, so that strata differ.
_GROUPED = "SELECT sample_id, substr(sha, 1, 2) AS group_id, CASE WHEN sample_id % 11 = 0 THEN 'S' WHEN label = 1 THEN 'F' ELSE 'G' END AS label FROM manifest"


def _grouped(manifest):
    return manifest.sparkSession.sql(_GROUPED.replace("FROM manifest", "FROM {m}"), m=manifest)


_SPLIT = (
    f"+ r AS ({_GROUPED}), g AS (SELECT group_id, string_agg(DISTINCT label, '|' ORDER BY label) AS labels, count(*) AS n_rows FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY labels ORDER BY sha256('42:' || labels || ':' || group_id)) AS k, count(*) OVER (PARTITION BY labels) AS n FROM g),"
    + " f AS (SELECT *, floor(n * 0.7::DOUBLE) AS a, floor(n * 0.15::DOUBLE) AS b, n - a - 2 * b AS rest, n * 0.7::DOUBLE - a AS ra, n * 0.15::DOUBLE - b AS rb FROM k), q AS (SELECT *, a + CASE WHEN CASE WHEN rb > ra THEN 2 ELSE 0 END < rest THEN 1 ELSE 0 END AS qa, b + CASE WHEN CASE WHEN ra >= rb THEN 1 ELSE 0 END < rest THEN 1 ELSE 0 END AS qb FROM f)"
)


@query(f"{_SPLIT} SELECT group_id, labels, n_rows, CASE WHEN k <= qa THEN 'train' WHEN k <= qa + qb THEN 'validation' ELSE 'test' END AS split FROM q", "manifest")
def l3_stratified_group_split(manifest):
    return c.stratified_group_split(_grouped(manifest), [0.7, 0.15, 0.15], "42")


@query(None, "manifest")
def l4_repair_label_coverage(manifest):
    return c.repair_label_coverage(c.stratified_group_split(_grouped(manifest), [0.7, 0.15, 0.15], "42"), ["F", "G", "S"], "42")


@query("SELECT group_id, CASE WHEN k <= n - 2 * q THEN 'train' WHEN k <= n - q THEN 'validation' ELSE 'test' END AS split FROM (SELECT group_id, row_number() OVER (ORDER BY sha256('7:' || group_id)) AS k, count(*) OVER () AS n, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS q FROM (SELECT DISTINCT group_id FROM manifest))", "manifest")
def l7_hash_group_split(manifest):
    return c.hash_group_split(manifest, "7")
