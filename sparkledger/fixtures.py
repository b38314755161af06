"""Views of the given tables in the shapes that the operators work on, in Spark SQL and in DuckDB.

Each view is one SELECT. The two texts differ only where the engines do; {name} marks such places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The places where the engines' spellings differ.
SPARK = {
    "step": "CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS INT)",
    "str": "STRING",
    "plus45": "o_orderdate + INTERVAL '45' MINUTE",
    "sha": "sha2(text, 256)",
    "words": "LATERAL VIEW posexplode(split(text, ' ', -1)) w AS pos, word",
    "bits": "aggregate(sequence(0, 31), 0L, (a, j) -> a + CASE WHEN embedding[{at}] > 0 THEN shiftleft(1L, 31 - j) ELSE 0L END)",
}
DUCKDB = {
    "step": "CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INT)",
    "str": "VARCHAR",
    "plus45": "o_orderdate + INTERVAL 45 MINUTE",
    "sha": "sha256(text)",
    "words": ", LATERAL (SELECT unnest(string_split(text, ' ')) AS word, CAST(unnest(range(0, len(string_split(text, ' ')))) AS INT) AS pos) w",
    "bits": "CAST(list_sum(list_transform(range(0, 32), lambda j: CASE WHEN embedding[CAST({at} + 1 AS INT)] > 0 THEN CAST(1 AS BIGINT) << CAST(31 - j AS INT) ELSE CAST(0 AS BIGINT) END)) AS BIGINT)",
}

VIEWS = {
    "tx": """
SELECT 'events' AS dataset_source, event_id AS row_no, {step} AS step, upper(event_type) AS transaction_type, value AS amount,
  'C' || CAST(user_id AS {str}) AS initiator_id,
  CASE k % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'C' ELSE 'X' END || CAST(k AS {str}) AS recipient_id,
  CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS label_is_fraud
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    "refs": """
SELECT o_orderkey AS ref_id,
  CASE o_custkey % 3 WHEN 0 THEN 'MTN_MOMO' WHEN 1 THEN 'TELECEL_CASH' ELSE 'AIRTELTIGO_MONEY' END AS provider_code,
  'ORD-' || lpad(CAST(CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS {str}), 8, '0') AS transaction_reference,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'GHS' AS currency,
  'CUSTOMER ' || CAST(o_custkey AS {str}) AS sender_name, '+23324' || lpad(CAST(o_custkey AS {str}), 7, '0') AS sender_phone,
  'SHOP ' || CAST(o_orderkey % 97 AS {str}) AS receiver_name,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE '+23350' || lpad(CAST(o_orderkey AS {str}), 7, '0') END AS receiver_phone,
  o_orderdate AS occurred_at,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING' ELSE 'REVERSED' END AS transaction_status,
  'SYS-' || CAST(o_orderkey AS {str}) AS source_system_id, CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS batch_id
FROM orders""",
    "batches": "SELECT 0 AS batch_id, 'COMMITTED' AS status UNION ALL SELECT 1 AS batch_id, 'VALIDATED' AS status",
    "obs": """
SELECT o_orderkey AS observation_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'GENERIC_MOMO' WHEN o_custkey % 3 = 0 THEN 'MTN_MOMO' WHEN o_custkey % 3 = 1 THEN 'TELECEL_CASH' ELSE 'AIRTELTIGO_MONEY' END AS provider_code,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'UNKNOWN-' || CAST(o_orderkey AS {str}) ELSE 'ORD-' || lpad(CAST(o_orderkey AS {str}), 8, '0') END AS transaction_reference,
  CAST(o_totalprice AS DECIMAL(18,2)) + CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS amount, 'GHS' AS currency,
  'CUSTOMER ' || CAST(CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END AS {str}) AS sender_name, '+23324' || lpad(CAST(o_custkey AS {str}), 7, '0') AS sender_phone,
  'SHOP ' || CAST(o_orderkey % 97 AS {str}) AS receiver_name,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE '+23350' || lpad(CAST(o_orderkey AS {str}), 7, '0') END AS receiver_phone,
  CASE WHEN o_orderkey % 11 = 0 THEN {plus45} ELSE o_orderdate END AS occurred_at,
  CASE WHEN o_orderkey % 13 = 0 THEN 'FAILED' WHEN o_orderstatus = 'F' THEN 'SUCCESS' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'REVERSED' END AS transaction_status,
  sha AS receipt_sha
FROM (SELECT *, o_custkey AS sha FROM orders)""",
    "hashes": """
SELECT vec_id AS id, hi, lo FROM h UNION ALL
SELECT vec_id + 1000000, hi, xor(lo, 1) FROM h WHERE vec_id % 10 = 0 UNION ALL
SELECT vec_id + 2000000, hi, xor(lo, 63) FROM h WHERE vec_id % 15 = 0 UNION ALL
SELECT vec_id + 3000000, hi, xor(lo, 127) FROM h WHERE vec_id % 20 = 0 UNION ALL
SELECT vec_id + 4000000, hi, lo FROM h WHERE vec_id % 25 = 0""",
    "scored": """
SELECT d.doc_id AS id, d.source AS group_id, l.quality AS label, CAST(least(10000, floor(d.n_chars * 2.5)) AS DOUBLE) / 10000 AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "scored3": """
SELECT row_no AS id, CASE k3 WHEN 0 THEN 'GENUINE' WHEN 1 THEN 'SUSPICIOUS' ELSE 'FRAUDULENT' END AS label,
  1 - 3 * a / 4 AS p_genuine, a / 4 AS p_suspicious, a / 2 AS p_fraudulent
FROM (SELECT row_no, amount / 500 AS a, CASE substr(recipient_id, 1, 1) WHEN 'M' THEN 0 WHEN 'C' THEN 1 ELSE 2 END AS k3 FROM tx)""",
    "manifest": """
SELECT d.doc_id AS sample_id, d.source AS group_id, {sha} AS sha, coalesce(l.quality, 0) AS label, d.lang AS source_type,
  CASE WHEN d.doc_id % 97 = 0 THEN 'test' ELSE CASE WHEN CAST(substr(d.source, 4) AS INT) % 5 = 0 THEN 'test' WHEN CAST(substr(d.source, 4) AS INT) % 5 = 1 THEN 'validation' ELSE 'train' END END AS split,
  CASE WHEN d.doc_id % 10 = 3 THEN d.doc_id - 1 WHEN d.doc_id % 101 = 0 THEN d.doc_id + 100000000 END AS parent_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "runs": """
SELECT event_id AS run_id, user_id AS transaction_id,
  CASE event_type WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'MEDIUM' WHEN 'purchase' THEN 'HIGH' ELSE NULL END AS risk_level,
  CASE WHEN event_id % 9 = 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status, CAST(floor(value * 10) AS INT) AS duration_ms,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS completed_at,
  CASE user_id % 3 WHEN 0 THEN 'MTN_MOMO' WHEN 1 THEN 'TELECEL_CASH' ELSE 'AIRTELTIGO_MONEY' END AS provider_code,
  CASE event_id % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'MISMATCH' ELSE 'UNVERIFIED' END AS verification_status
FROM events""",
    "state_events": """
SELECT user_id AS record_id, event_id AS seq, event_type AS to_state,
  CASE WHEN event_id % 17 = 0 THEN 'none' ELSE lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) END AS from_state
FROM events""",
    "msgs": """
SELECT doc_id AS record_id, source AS provider_family, lang AS source_corpus,
  'Payment made for GHS ' || CAST(n_chars AS {str}) || '.50 to SHOP ' || CAST(doc_id % 97 AS {str}) || '. Transaction ID: ORD' || lpad(CAST(doc_id AS {str}), 9, '0')
  || CASE WHEN doc_id % 3 = 0 THEN ' call 0241234' || lpad(CAST(doc_id % 1000 AS {str}), 3, '0') ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN ' mail a' || CAST(doc_id AS {str}) || '@shop.example.com' ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN ' see https://shop.example.com/p/' || CAST(doc_id AS {str}) ELSE '' END
  || CASE WHEN doc_id % 13 = 0 THEN ' Your OTP is 4711' ELSE '' END || ' ' || text AS text,
  CASE doc_id % 4 WHEN 0 THEN 'MobileMoney' WHEN 1 THEN '4455' WHEN 2 THEN '+233241234567' ELSE '' END AS sender, doc_id % 19 <> 0 AS incoming
FROM documents""",
    "receipts": """
SELECT o_orderkey AS receipt_id,
  CASE o_custkey % 5 WHEN 0 THEN 'MTN Mobile Money' WHEN 1 THEN 'Telecel Cash' WHEN 2 THEN 'AirtelTigo Money' WHEN 3 THEN 'Telecel and MTN' ELSE 'Receipt' END || chr(10)
  || CASE WHEN o_orderkey % 6 = 0 THEN 'no number' WHEN o_orderkey % 2 = 0 THEN 'Transaction ID: TX' || lpad(CAST(o_orderkey AS {str}), 9, '0') ELSE 'Reference ORD-' || lpad(CAST(o_orderkey AS {str}), 8, '0') END || chr(10)
  || CASE WHEN o_orderkey % 7 = 0 THEN 'free' WHEN o_orderkey % 11 = 0 THEN 'GHS 5.00 GHS ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {str}) ELSE 'Amount: GHS ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {str}) END || chr(10)
  || CASE o_orderkey % 4 WHEN 0 THEN 'Recipient name: Shop ' || CAST(o_orderkey % 97 AS {str}) WHEN 1 THEN 'Payment made now to Shop ' || CAST(o_orderkey % 97 AS {str}) || ' on Monday' WHEN 2 THEN 'Cash in from Shop ' || CAST(o_orderkey % 97 AS {str}) || '.' ELSE '-' END || chr(10)
  || CASE o_orderkey % 9 WHEN 0 THEN 'Wallet: 024' || lpad(CAST(o_custkey AS {str}), 7, '0') WHEN 1 THEN 'call +23324' || lpad(CAST(o_custkey AS {str}), 7, '0') WHEN 2 THEN 'call 0501234567 or 0241234567' WHEN 3 THEN 'Wallet: 12345678' ELSE '-' END || chr(10)
  || 'Date: ' || CASE o_orderkey % 3 WHEN 0 THEN CAST(year(o_orderdate) AS {str}) || '-' || lpad(CAST(month(o_orderdate) AS {str}), 2, '0') || '-' || lpad(CAST(day(o_orderdate) AS {str}), 2, '0') || ' 10:20:30'
    WHEN 1 THEN lpad(CAST(day(o_orderdate) AS {str}), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS {str}), 2, '0') || '/' || CAST(year(o_orderdate) AS {str}) || ' 10:20' ELSE '99/99/2001 10:20' END || chr(10)
  || CASE o_orderkey % 8 WHEN 0 THEN 'Status: Successful' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed, reversed' WHEN 3 THEN 'PENDING' ELSE 'thanks' END AS text,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount, 'TX' || lpad(CAST(o_orderkey AS {str}), 9, '0') AS reference,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'SHOP ' || CAST(o_orderkey % 97 AS {str}) END AS recipient_name, '+23324' || lpad(CAST(o_custkey AS {str}), 7, '0') AS recipient_wallet,
  CAST(o_orderkey % 100 AS DOUBLE) / 100 AS engine_confidence
FROM orders""",
    "tokens": """
SELECT conv_id AS doc, turn AS line, pos, word AS text, CAST(40 * pos AS DOUBLE) AS x, CAST(8 * length(word) AS DOUBLE) AS width, CAST(20 * turn + pos % 3 AS DOUBLE) AS y, CAST(12 + length(word) % 12 AS DOUBLE) AS height,
  CAST((pos * 7 + turn * 13) % 101 AS DOUBLE) AS confidence
FROM conversations {words}""",
    "ocr_runs": """
SELECT event_id AS record_id, CASE user_id % 3 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'easyocr' ELSE 'paddleocr' END AS engine,
  CASE user_id % 3 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'easyocr' ELSE 'paddleocr' END || '-v' || CAST(event_id % 4 AS {str}) AS configuration_id,
  CASE WHEN event_id % 31 = 0 AND user_id % 5 = 0 THEN 'TIMEOUT' WHEN event_id % 61 = 0 THEN 'DECODE' END AS failure,
  CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 0 ELSE 1 END AS amount, CASE WHEN event_id % (9 + user_id % 3) = 0 THEN 0 ELSE 1 END AS reference,
  CASE WHEN event_id % 19 = 0 THEN 0 ELSE 1 END AS timestamp, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0 ELSE 1 END AS recipient,
  CAST(event_id % 100 AS DOUBLE) / 200 AS cer, CAST(event_id % 80 AS DOUBLE) / 160 AS wer, value AS latency_ms
FROM events""",
    "measures": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS blur,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 9 AS DOUBLE) / 2 END AS aspect_ratio, CAST(o_orderkey % 4 AS DOUBLE) AS duplicates, CAST(o_custkey % 3 AS DOUBLE) AS metadata_conflict
FROM orders""",
}
_BASES = ["events", "orders", "documents", "labels", "embeddings", "conversations", "pages", "customer", "lineitem"]
#: Views that read others.
NEEDS = {"scored3": ["tx"], "hashes": ["h"]}
_H = "SELECT vec_id, {hi} AS hi, {lo} AS lo FROM embeddings"


def _text(name: str, words: dict[str, str]) -> str:
    if name == "h":
        return _H.format(hi=words["bits"].replace("{at}", "j"), lo=words["bits"].replace("{at}", "j + 32"))
    out = VIEWS[name]
    for k in ("step", "str", "plus45", "sha", "words"):
        out = out.replace("{" + k + "}", words[k])
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables of sf_dir."""
    text = _text(name, SPARK).replace("xor(lo, 1)", "lo ^ 1L").replace("xor(lo, 63)", "lo ^ 63L").replace("xor(lo, 127)", "lo ^ 127L")
    args = {}
    for t in _BASES:
        if f"FROM {t}" in text or f"JOIN {t}" in text:
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for t in NEEDS.get(name, []):
        args[t] = view(spark, sf_dir, t)
    for t in args:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(text, **args) if args else spark.sql(text)


def duckdb_with(*names: str) -> str:
    """'WITH ...' that defines the views in DuckDB, with those they need."""
    parts: dict[str, str] = {}
    for n in names:
        for t in [*NEEDS.get(n, []), n]:
            parts[t] = _text(t, DUCKDB)
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items())
