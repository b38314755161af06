"""A query for each operator over the fixture views, with the SQL that says the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import VIEWS, duckdb_with, view
from ..functions import text
from ..operators import causal, evaluation, governance, messages, references, transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """Register a query; views are the fixture views that it gets, as DataFrames, and that its SQL can name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) if v in _VIEWS else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in views))
        if sql is not None:
            named = [v for v in views if v in _VIEWS]
            with_ = duckdb_with(*named) if named else ""
            SQL[f.__name__] = f"{with_}{',' if with_ and sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"
        return f

    return add


_VIEWS = set(VIEWS)
PLAN = "CASE WHEN step <= (SELECT max(step) FILTER (WHERE k <= n * 70 // 100) FROM s) THEN 'train' WHEN step <= (SELECT max(step) FILTER (WHERE k <= n * 80 // 100) FROM s) THEN 'tuning' WHEN step <= (SELECT max(step) FILTER (WHERE k <= n * 90 // 100) FROM s) THEN 'calibration' ELSE 'test' END"
PARTED = f"+ s AS (SELECT step, row_number() OVER (ORDER BY step) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT step FROM tx)), parted AS (SELECT *, {PLAN} AS partition FROM tx)"


def parted(tx: DataFrame) -> DataFrame:
    return transactions.assign_partition(tx, transactions.plan_time_split(transactions.step_statistics(tx)))


R = "round({}, 6)"
_PRIOR = "OVER (PARTITION BY initiator_id ORDER BY step RANGE BETWEEN {} PRECEDING AND 1 PRECEDING)"


@query(
    f"{PARTED} SELECT row_no, step, initiator_id, partition, "
    + ", ".join(f"count(*) {_PRIOR.format(k)} AS prior_{k}h_count, round(coalesce(sum(amount) {_PRIOR.format(k)}, 0), 6) AS prior_{k}h_amount" for k in (1, 6, 24))
    + " FROM parted",
    "tx",
)
def w1_velocity(tx):
    d = causal.velocity(parted(tx))
    return d.select("row_no", "step", "initiator_id", "partition", *(F.round(f"prior_{k}h_amount", 6).alias(f"prior_{k}h_amount") for k in (1, 6, 24)), *(f"prior_{k}h_count" for k in (1, 6, 24)))


@query(
    f"SELECT row_no, round(avg(amount) {_PRIOR.format(24)}, 6) AS prior_mean, round(median(amount) {_PRIOR.format(24)}, 6) AS prior_median, round(CASE WHEN median(amount) {_PRIOR.format(24)} <> 0 THEN amount / median(amount) {_PRIOR.format(24)} END, 6) AS amount_to_median FROM tx",
    "tx",
)
def w2_prior_summary(tx):
    return causal.prior_summary(tx).select("row_no", *(F.round(c, 6).alias(c) for c in ("prior_mean", "prior_median", "amount_to_median")))


@query(f"SELECT row_no, step - max(step) {_PRIOR.format(24)} AS steps_since_previous FROM tx", "tx")
def w3_time_since_previous(tx):
    return causal.time_since_previous(tx).select("row_no", "steps_since_previous")


@query(f"SELECT row_no, coalesce(arg_max(transaction_type, CAST(step AS BIGINT) * 1000000000 + row_no) {_PRIOR.format(24)}, 'START') || '->' || transaction_type AS sequence_pattern FROM tx", "tx")
def w4_sequence_pattern(tx):
    return causal.sequence_pattern(tx).select("row_no", "sequence_pattern")


@query(
    f"SELECT row_no, CAST(count(DISTINCT recipient_id) {_PRIOR.format(24)} AS INT) AS unique_recipients, CAST(NOT coalesce(list_contains(list(recipient_id) {_PRIOR.format(24)}, recipient_id), false) AS INT) AS is_new_recipient FROM tx",
    "tx",
)
def w5_recipients(tx):
    return causal.recipients(tx).select("row_no", "unique_recipients", "is_new_recipient")


@query(
    "+ e AS (SELECT initiator_id AS a, recipient_id AS o, step, row_no, 1 AS own FROM tx UNION ALL SELECT recipient_id, initiator_id, step, row_no, 0 FROM tx), w AS (SELECT row_no, own, count(DISTINCT o) OVER (PARTITION BY a ORDER BY step RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING) AS d FROM e) SELECT row_no, CAST(d AS INT) AS graph_degree FROM w WHERE own = 1",
    "tx",
)
def w6_graph_degree(tx):
    return causal.graph_degree(tx)


@query(
    "SELECT row_no, sha256(dataset_source || chr(0) || 'h' || chr(0) || CAST(row_no AS VARCHAR)) AS source_row_id, step, transaction_type, amount, initiator_id, recipient_id, label_is_fraud, CASE substr(initiator_id, 1, 1) WHEN 'C' THEN 'CUSTOMER' WHEN 'M' THEN 'MERCHANT' ELSE 'UNKNOWN' END AS initiator_role, CASE substr(recipient_id, 1, 1) WHEN 'C' THEN 'CUSTOMER' WHEN 'M' THEN 'MERCHANT' ELSE 'UNKNOWN' END AS recipient_role FROM tx",
    "tx",
)
def p1_p2_p4_canonical(tx):
    c = transactions.DIALECTS["paysim"]
    raw = tx.select("row_no", *(F.concat(F.lit(" "), F.lower(F.col(k)) if k == "transaction_type" else F.col(k).cast("string")).alias(v) for k, v in c.items()))
    out = raw.select("row_no", "*")
    d = transactions.canonicalize(out, "paysim", "events", "h")
    ids = tx.select("row_no", transactions.opaque_row_id(F.lit("events"), F.lit("h"), F.col("row_no")).alias("source_row_id"))
    role = {f"{k}_role": transactions.actor_role(F.col(f"{k}_id")) for k in ("initiator", "recipient")}
    return d.join(ids, "source_row_id").withColumns(role).drop("dataset_source")


@query(
    "SELECT row_no, concat_ws(',', CASE WHEN amount > 400 OR amount IS NULL THEN 'BAD_AMOUNT' END, CASE WHEN row_no % 100 = 3 THEN 'BAD_LABEL' END, CASE WHEN step < 5 THEN 'BAD_STEP' END) AS error_codes FROM tx WHERE amount > 400 OR row_no % 100 = 3 OR step < 5",
    "tx",
)
def p3_quarantine(tx):
    bad = tx.withColumns({"amount": F.when(F.col("amount") <= 400, F.col("amount")).otherwise(-F.col("amount")), "step": F.col("step") - 5, "label_is_fraud": F.when(F.col("row_no") % 100 == 3, 7).otherwise(F.col("label_is_fraud"))})
    return transactions.quarantine(bad)[1].select("row_no", F.array_join("error_codes", ",").alias("error_codes"))


@query("SELECT row_no, round(ln(1 + amount), 9) AS amount_log1p, round(sin(2 * pi() * (step % 24) / 24), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * (step % 24) / 24), 9) + 0.0 AS hour_cos FROM tx", "tx")
def p5_encodings(tx):
    return transactions.encodings(tx).select("row_no", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("amount_log1p", "hour_sin", "hour_cos")))


@query("SELECT step, count(*) AS n_rows, CAST(sum(label_is_fraud) AS BIGINT) AS positives FROM tx GROUP BY step", "tx")
def a3_step_statistics(tx):
    return transactions.step_statistics(tx)


@query(f"{PARTED} SELECT partition, min(step) AS min_step, max(step) AS max_step, count(DISTINCT step) AS n_steps, count(*) AS n_rows, CAST(sum(label_is_fraud) AS BIGINT) AS positives, round(sum(label_is_fraud) / count(*), 6) AS prevalence FROM parted GROUP BY partition", "tx")
def a4_partition_summary(tx):
    return transactions.partition_summary(parted(tx))


@query(
    "+ st AS (SELECT step, sum(label_is_fraud) AS p, row_number() OVER (ORDER BY step) AS k FROM tx GROUP BY step), n AS (SELECT max(k) AS n FROM st),"
    " c AS (SELECT 0 AS k, 0 AS c UNION ALL SELECT k, sum(p) OVER (ORDER BY k) FROM st), t AS (SELECT n, n * 70 // 100 AS t1, n * 80 // 100 AS t2, n * 90 // 100 AS t3, (SELECT max(c) FROM c) AS p FROM n),"
    " x AS (SELECT a.k AS a, b.k AS b, d.k AS d FROM c a, c b, c d, t WHERE 0 < a.k AND a.k < b.k AND b.k < d.k AND d.k < n AND b.c - a.c >= p // 5 AND d.c - b.c >= p // 5 AND p - d.c >= p // 5 ORDER BY abs(a.k - t1) + abs(b.k - t2) + abs(d.k - t3), a.k, b.k, d.k LIMIT 1),"
    " e AS (SELECT 'train' AS partition, 0 AS lo, a AS hi FROM x UNION ALL SELECT 'tuning', a, b FROM x UNION ALL SELECT 'calibration', b, d FROM x UNION ALL SELECT 'test', d, n FROM x, n)"
    " SELECT partition, (SELECT step FROM st WHERE k = lo + 1) AS first_step, (SELECT step FROM st WHERE k = hi) AS last_step, true AS enforced FROM e",
    "tx",
)
def l1_positive_split(tx):
    stats = transactions.step_statistics(tx)
    return transactions.split_plan(stats, stats.agg(F.sum("positives")).first()[0] // 5)  # a fifth of the positives in each later partition


@query(f"{PARTED} SELECT partition, transaction_type, count(*) AS n_rows, CAST(sum(label_is_fraud) AS BIGINT) AS positives, min(amount) AS min_amount, max(amount) AS max_amount, round(avg(amount), 6) AS mean_amount FROM parted WHERE partition IN ('train', 'tuning') GROUP BY ALL", "tx")
def a5_safe_eda(tx):
    return transactions.safe_eda(parted(tx))


@query(
    f"{PARTED}, f AS (SELECT avg(amount) AS m, list_append(list_sort(list(DISTINCT transaction_type)), '__UNKNOWN__') AS v FROM parted WHERE partition = 'train') SELECT round(m, 6) AS mean_amount, array_to_string(v, ',') AS vocabulary FROM f",
    "tx",
)
def a6_fit_preprocessor(tx):
    f = transactions.fit_preprocessor(parted(tx).where("partition = 'train'"), ["amount"], ["transaction_type"])
    return f.select(F.round("mean_amount", 6).alias("mean_amount"), F.array_join("vocabulary_transaction_type", ",").alias("vocabulary"))


@query(
    f"{PARTED}, f AS (SELECT avg(amount) AS m FROM parted WHERE partition = 'train' AND transaction_type <> 'CLICK' AND amount <= 400) SELECT row_no, round(CASE WHEN amount <= 400 THEN amount ELSE m END, 6) AS amount, CASE WHEN transaction_type = 'CLICK' THEN '__UNKNOWN__' ELSE transaction_type END AS transaction_type FROM parted, f",
    "tx",
)
def a7_apply_preprocessor(tx):
    d = parted(tx).withColumn("amount", F.when(F.col("amount") <= 400, F.col("amount")))
    f = transactions.fit_preprocessor(d.where("partition = 'train' AND transaction_type <> 'CLICK'"), ["amount"], ["transaction_type"])
    return transactions.apply_preprocessor(d, f, ["amount"], ["transaction_type"]).select("row_no", F.round("amount", 6).alias("amount"), "transaction_type")


@query("SELECT median(amount) AS median_amount, (SELECT recipient_id FROM tx GROUP BY 1 ORDER BY count(*) DESC, recipient_id LIMIT 1) AS mode_recipient_id FROM tx", "tx")
def a26_fit_imputer(tx):
    return transactions.fit_imputer(tx, ["amount"], ["recipient_id"])


# The transactions with some nulls, amounts and labels that are none, and rows that are there twice.
_SPOILT = (
    "SELECT row_no, step, transaction_type, CASE WHEN row_no % 101 = 0 THEN NULL WHEN row_no % 103 = 0 THEN -1 ELSE amount END AS amount, initiator_id,"
    " CASE WHEN row_no % 113 = 0 THEN NULL ELSE recipient_id END AS recipient_id, CASE WHEN row_no % 107 = 0 THEN 2 ELSE label_is_fraud END AS label_is_fraud FROM tx"
)
_TWICE = f"{_SPOILT} UNION ALL {_SPOILT} WHERE row_no % 109 = 0 UNION ALL {_SPOILT} WHERE row_no % 218 = 0"


@query(
    f"+ d AS ({_TWICE}), g AS (SELECT *, count(*) AS n FROM d GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n * label_is_fraud) AS BIGINT) AS positives, count(DISTINCT step) AS n_steps,"
    " CAST(sum(n * (CASE WHEN amount IS NULL THEN 1 ELSE 0 END + CASE WHEN recipient_id IS NULL THEN 1 ELSE 0 END)) AS BIGINT) AS null_cells, CAST(sum(CASE WHEN amount IS NULL OR amount < 0 THEN n ELSE 0 END) AS BIGINT) AS invalid_amounts,"
    " CAST(sum(CASE WHEN label_is_fraud NOT IN (0, 1) THEN n ELSE 0 END) AS BIGINT) AS invalid_labels, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM g",
    "tx",
)
def a1_profile(tx):
    d = tx.sparkSession.sql(_TWICE.replace("FROM tx", "FROM {t}"), t=tx)
    return transactions.profile(d, d.columns)


@query("SELECT concat_ws(',', CASE WHEN count(*) <> 10000 THEN 'N_ROWS_DRIFT' END, CASE WHEN sum(label_is_fraud) <> 7 THEN 'POSITIVES_DRIFT' END) AS reasons FROM tx", "tx")
def a2_drift_reasons(tx):
    return transactions.drift_reasons(tx.agg(F.count("*").alias("n_rows"), F.sum("label_is_fraud").alias("positives")), {"n_rows": 10_000, "positives": 7})


# All columns of orders, in forms that both engines write alike.
_ORDER = {
    "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {})", "o_orderdate": "CAST(CAST(o_orderdate AS DATE) AS {})",
    "o_orderpriority": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END",
}


@query("SELECT o_orderkey, sha256(to_json({" + ", ".join(f"'{c}': {e.format('VARCHAR')}" for c, e in _ORDER.items()) + "})) AS h FROM orders", "orders")
def p13_row_hash(orders):
    d = orders.selectExpr(*(f"{e.format('STRING')} AS {c}" for c, e in _ORDER.items()))
    return d.select("o_orderkey", transactions.row_hash(*d.columns).alias("h"))


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY text", "documents")
def w7_first_occurrences(documents):
    return transactions.first_occurrences(documents.select("text", "doc_id", "source"), ["text"], "doc_id")


@query("+ g AS (SELECT sha, count(*) AS n, sum(label) AS p, max(label) AS k FROM manifest GROUP BY sha) SELECT CAST(sum(n) AS BIGINT) AS rows_in, count(*) AS rows_out, CAST(sum(n) - count(*) AS BIGINT) AS removed, count_if(n > 1)::BIGINT AS duplicate_groups, max(n) AS max_group, CAST(sum(p) AS BIGINT) AS positives_before, CAST(sum(k) AS BIGINT) AS positives_after, CAST(sum(p) - sum(k) AS BIGINT) AS positives_removed FROM g", "manifest")
def a8_dedup_manifest(manifest):
    return transactions.dedup_manifest(manifest, ["sha"], "label")


@query("SELECT label_is_fraud AS label, count(*) AS n, round((SELECT count(*) FROM tx) / (2.0 * count(*)), 8) AS weight FROM tx GROUP BY 1", "tx")
def a23_class_weights(tx):
    return transactions.class_weights(tx, "label_is_fraud")


@query("+ c AS (SELECT count_if(label_is_fraud = 1) AS p, count_if(label_is_fraud = 0) AS n FROM tx), k AS (SELECT CASE WHEN p + n <= 500 THEN p ELSE least(p, 250) END AS p, n FROM c) SELECT 1 AS label, CAST(p AS BIGINT) AS n FROM k WHERE p > 0 UNION ALL SELECT 0, CAST(least(n, 500 - p) AS BIGINT) FROM k WHERE n > 0", "tx")
def t3_stratified_cap(tx):
    return transactions.stratified_cap(tx, 500, "row_no", "label_is_fraud").groupBy(F.col("label_is_fraud").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT row_no FROM tx ORDER BY sha256('7:' || CAST(row_no AS VARCHAR)), row_no LIMIT 100", "tx")
def t2_hash_subset(tx):
    return transactions.hash_subset(tx, "row_no", "7", 100).select("row_no")


@query("SELECT transaction_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY completed_at DESC NULLS LAST, run_id DESC) AS k FROM runs) WHERE k = 1", "runs")
def w9_latest_per_key(runs):
    return transactions.latest_per_key(runs, "transaction_id", "completed_at", "run_id").select("transaction_id", "run_id", "status")


@query("SELECT transaction_id, run_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY completed_at DESC NULLS LAST, run_id DESC) AS k FROM runs) WHERE k <= 20", "runs")
def w10_recent_n(runs):
    return transactions.recent_n(runs, "transaction_id", "completed_at", "run_id", 20).select("transaction_id", "run_id", "rank")


_RESOLVED = """+ good AS (SELECT * FROM refs WHERE batch_id IN (SELECT batch_id FROM batches WHERE status = 'COMMITTED')),
hits AS (SELECT o.observation_id, r.ref_id, NOT coalesce(o.provider_code = 'GENERIC_MOMO', true) AS exact FROM obs o JOIN good r ON o.transaction_reference = r.transaction_reference AND (o.provider_code IS NULL OR o.provider_code = 'GENERIC_MOMO' OR o.provider_code = r.provider_code)),
agg AS (SELECT observation_id, count(*) AS n, min(ref_id) AS only_id, bool_or(exact) AS exact FROM hits GROUP BY 1),
resolved AS (SELECT o.observation_id, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN only_id END AS ref_id, CASE WHEN o.transaction_reference IS NULL THEN 'NO_CANONICAL_REFERENCE' WHEN n IS NULL THEN 'NO_REFERENCE_RECORD' WHEN n > 1 THEN 'AMBIGUOUS_PROVIDER_REFERENCE' WHEN exact THEN 'EXACT_PROVIDER_REFERENCE' ELSE 'UNIQUE_REFERENCE_FALLBACK' END AS method FROM obs o LEFT JOIN agg a ON o.observation_id = a.observation_id)"""


def _eq(c: str) -> str:
    return f"SELECT observation_id, '{c}' AS field, CASE WHEN o_{c} IS NULL OR r_{c} IS NULL THEN 'NOT_AVAILABLE' WHEN o_{c} = r_{c} THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM m"


# Each name of a pair is cut at its longest common part (the first in a, then in b) until nothing is shared.
_BEST = "list_max(flatten(list_transform(range(1, length({0}) + 1), lambda i: list_transform(range(1, length({0}) - i + 2), lambda n: CASE WHEN contains({1}, substr({0}, i, n)) THEN n * 1000 + 999 - i END))))"
_RATIO = f"""names AS (SELECT DISTINCT lower(o_sender_name) AS a, lower(r_sender_name) AS b FROM m WHERE lower(o_sender_name) <> lower(r_sender_name) UNION SELECT lower(o_receiver_name), lower(r_receiver_name) FROM m WHERE lower(o_receiver_name) <> lower(r_receiver_name)),
cuts AS (WITH RECURSIVE cut AS (SELECT a, b, a AS x, b AS y, {_BEST.format('a', 'b')} AS best FROM names UNION ALL
  SELECT a, b, x, y, {_BEST.format('x', 'y')} FROM (SELECT a, b, CASE side WHEN 0 THEN substr(x, 1, i - 1) ELSE substr(x, i + n) END AS x, CASE side WHEN 0 THEN substr(y, 1, j - 1) ELSE substr(y, j + n) END AS y
    FROM (SELECT *, best // 1000 AS n, 999 - best % 1000 AS i, instr(y, substr(x, CAST(999 - best % 1000 AS BIGINT), CAST(best // 1000 AS BIGINT))) AS j, unnest([0, 1]) AS side FROM cut WHERE best IS NOT NULL)))
  SELECT a, b, 2.0 * sum(coalesce(best // 1000, 0)) / (length(a) + length(b)) AS ratio FROM cut GROUP BY a, b)"""


def _name(c: str) -> str:
    return f"SELECT observation_id, '{c}' AS field, CASE WHEN coalesce(o_{c}, '') = '' OR coalesce(r_{c}, '') = '' THEN 'NOT_AVAILABLE' WHEN coalesce(ratio, 1) >= 0.9 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM m LEFT JOIN cuts ON a = lower(o_{c}) AND b = lower(r_{c})"


_COMPARED = (
    _RESOLVED
    + ", m AS (SELECT x.observation_id, "
    + ", ".join(f"o.{c} AS o_{c}, r.{c} AS r_{c}" for c in ("amount", "currency", "sender_phone", "receiver_phone", "sender_name", "receiver_name", "occurred_at", "transaction_status"))
    + f" FROM resolved x JOIN obs o ON x.observation_id = o.observation_id JOIN refs r ON x.ref_id = r.ref_id), {_RATIO}, cmp AS ("
    + " UNION ALL ".join(
        [
            "SELECT observation_id, 'amount' AS field, CASE WHEN abs(o_amount - r_amount) <= 0 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM m",
            *map(_eq, ("currency", "sender_phone", "receiver_phone", "transaction_status")),
            *map(_name, ("sender_name", "receiver_name")),
            "SELECT observation_id, 'occurred_at', CASE WHEN o_occurred_at IS NULL OR r_occurred_at IS NULL THEN 'NOT_AVAILABLE' WHEN abs(epoch(o_occurred_at) - epoch(r_occurred_at)) <= 1800 THEN 'MATCH' ELSE 'MISMATCH' END FROM m",
        ]
    )
    + ")"
)


def _resolved(obs, refs, batches):
    good = references.committed(refs, batches)
    return good, references.resolve(obs, good)


@query(f"{_RESOLVED} SELECT * FROM resolved", "obs", "refs", "batches")
def j1_j3_resolve(obs, refs, batches):
    return _resolved(obs, refs, batches)[1]


@query(f"{_COMPARED} SELECT * FROM cmp", "obs", "refs", "batches")
def j4_compare_fields(obs, refs, batches):
    good, r = _resolved(obs, refs, batches)
    return references.compare_fields(obs, good, r)


@query(
    f"{_COMPARED} SELECT a, b, round(ratio, 6) AS ratio, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS edit_ratio FROM cuts",
    "obs", "refs", "batches",
)
def u2_name_similarity(obs, refs, batches):
    good, r = _resolved(obs, refs, batches)
    m = r.select("observation_id", "ref_id").join(obs.alias("o"), "observation_id").join(good.alias("r"), "ref_id")
    pairs = F.explode(F.array(*(F.struct(F.lower(f"o.{c}").alias("a"), F.lower(f"r.{c}").alias("b")) for c in ("sender_name", "receiver_name"))))
    d = m.select(pairs.alias("p")).select("p.a", "p.b").where("a <> b").distinct()
    return d.select("a", "b", F.round(text.sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), F.round(text.levenshtein_ratio(F.col("a"), F.col("b")), 6).alias("edit_ratio"))


@query(None, "documents")
def u3_compatibility_form(documents):
    return documents.select("doc_id", F.length(text.clean_text(F.col("text"))).alias("n_chars"), F.md5(text.clean_text(F.col("text"))).alias("digest"))


@query(
    f"{_COMPARED} SELECT observation_id, CASE WHEN bool_or(crit AND status = 'MISMATCH') THEN 'MISMATCH' WHEN bool_or(crit AND status = 'NOT_AVAILABLE') THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verification_status, count_if(status = 'MATCH')::BIGINT AS matched, count_if(status = 'MISMATCH')::BIGINT AS mismatched FROM (SELECT *, field IN ('amount', 'currency', 'receiver_phone', 'transaction_status') AS crit FROM cmp) GROUP BY 1",
    "obs", "refs", "batches",
)
def j5_verification_status(obs, refs, batches):
    good, r = _resolved(obs, refs, batches)
    return references.verification_status(references.compare_fields(obs, good, r))


@query(
    f"{_RESOLVED}, w AS (SELECT observation_id, 'REFERENCE_ALREADY_USED' AS w FROM (SELECT *, min(observation_id) OVER (PARTITION BY ref_id) AS f FROM resolved WHERE ref_id IS NOT NULL) WHERE observation_id > f UNION ALL SELECT observation_id, 'RECEIPT_REUSED' FROM (SELECT *, count(*) OVER (PARTITION BY receipt_sha) AS n FROM obs) WHERE n > 1) SELECT observation_id, string_agg(DISTINCT w, ',' ORDER BY w) AS warnings FROM w GROUP BY 1",
    "obs", "refs", "batches",
)
def j6_reuse_warnings(obs, refs, batches):
    return references.reuse_warnings(obs, _resolved(obs, refs, batches)[1])


_SYSTEM = "SELECT ref_id, provider_code, transaction_reference, 'SYS-' || CAST(CAST(floor(ref_id / 100) AS BIGINT) AS {}) AS source_system_id FROM refs"


@query(f"SELECT ref_id FROM (SELECT *, row_number() OVER (PARTITION BY provider_code, transaction_reference, source_system_id ORDER BY ref_id) AS n FROM ({_SYSTEM.format('VARCHAR')})) WHERE n > 1", "refs")
def w8_in_file_duplicates(refs):
    d = refs.sparkSession.sql(_SYSTEM.format("STRING").replace("FROM refs", "FROM {r}"), r=refs)
    return references.in_file_duplicates(d, ["provider_code", "transaction_reference", "source_system_id"], "ref_id").select("ref_id")


@query("SELECT ref_id FROM refs WHERE (provider_code, transaction_reference, source_system_id) IN (SELECT provider_code, transaction_reference, source_system_id FROM refs WHERE batch_id = 1)", "refs")
def j19_import_conflicts(refs):
    return references.import_conflicts(refs, refs.where("batch_id = 1"), ["provider_code", "transaction_reference", "source_system_id"]).select("ref_id")


@query("SELECT ref_id, CASE WHEN length(receiver_phone) > 7 THEN substr(receiver_phone, 1, 4) || '...' || right(receiver_phone, 2) ELSE receiver_phone END AS receiver_phone, sender_phone AS canonical_phone FROM refs", "refs")
def p9_mask(refs):
    return refs.select("ref_id", references.masked(F.col("receiver_phone")).alias("receiver_phone"), references.canonical_phone(F.concat(F.lit("0"), F.substring("sender_phone", 5, 9))).alias("canonical_phone"))


_SIGN = "CAST(hi AS HUGEINT) * 4294967296 + lo"


@query("+ u AS (SELECT min(id) AS id, hi, lo FROM hashes GROUP BY hi, lo) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INT) AS distance FROM u a JOIN u b ON a.id < b.id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6", "hashes")
def j12_near_duplicates(hashes):
    return references.near_duplicates(hashes, 6)


@query(
    "+ u AS (SELECT min(id) AS first, hi, lo, count(*) AS n FROM hashes GROUP BY hi, lo),"
    " p AS (SELECT a.hi, a.lo, b.first, b.n, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS d FROM u a JOIN u b ON a.first <> b.first),"
    " s AS (SELECT hi, lo, sum(n) AS k, min(d) AS least, min(first) AS near FROM p WHERE d <= 6 GROUP BY hi, lo)"
    " SELECT h.id, u.n - 1 AS copies, CAST(coalesce(k, 0) AS BIGINT) AS near_count, CAST(least AS INT) AS min_distance, near AS first_near"
    " FROM hashes h JOIN u ON h.hi = u.hi AND h.lo = u.lo LEFT JOIN s ON h.hi = s.hi AND h.lo = s.lo",
    "hashes",
)
def j12_near_counts(hashes):
    return references.near_counts(hashes, 6)


@query("SELECT id, original FROM (SELECT id, min(id) OVER (PARTITION BY hi, lo) AS original FROM hashes) WHERE id > original", "hashes")
def j11_exact_duplicates(hashes):
    d = hashes.select("id", F.concat_ws(":", "hi", "lo").alias("h"))
    return governance.exact_duplicate_pairs(d, "h", "id")


_CURVE = """+ t AS (SELECT DISTINCT score AS threshold FROM scored UNION SELECT 0.0 UNION SELECT 1.0), g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY score),
c AS (SELECT threshold, coalesce(sum(p), 0) AS tp, coalesce(sum(n), 0) AS fp FROM t LEFT JOIN g ON score >= threshold GROUP BY threshold),
d AS (SELECT threshold, tp, fp, (SELECT sum(p) FROM g) - tp AS fn, (SELECT sum(n) FROM g) - fp AS tn FROM c),
curve AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 8) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 8) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 8) AS fpr, round(CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END, 8) AS f2 FROM d)"""


@query(f"{_CURVE} SELECT * FROM curve", "scored")
def e1_threshold_curve(scored):
    return evaluation.threshold_curve(scored.withColumn("score", F.col("score").cast("double")))


@query(
    "+ g AS (SELECT score, sum(label) AS p, count(*) AS n FROM scored GROUP BY score),"
    " c AS (SELECT p, n, sum(p) OVER d AS tp, sum(n) OVER d AS k, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),"
    " s AS (SELECT sum(p * tp / k) AS ap, sum(p * (below + (n + 1) / 2)) AS ranks, sum(p) AS p, sum(n) AS t FROM c),"
    " h AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp_05, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp_05, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn_05, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn_05 FROM scored)"
    " SELECT CAST(t AS BIGINT) AS n_rows, round(p / t, 8) AS prevalence, round(ap / p, 8) AS average_precision, round((ranks - p * (p + 1) / 2) / (p * (t - p)), 8) AS roc_auc, round((SELECT avg(pow(score - label, 2)) FROM scored), 8) AS brier,"
    " h.*, round(coalesce(tp_05 / nullif(tp_05 + fp_05, 0), 0), 8) AS precision_05, round(coalesce(tp_05 / nullif(tp_05 + fn_05, 0), 0), 8) AS recall_05, round(coalesce(2 * tp_05 / nullif(2 * tp_05 + fp_05 + fn_05, 0), 0), 8) AS f1_05,"
    " round(coalesce(fp_05 / nullif(fp_05 + tn_05, 0), 0), 8) AS fpr_05, round(coalesce(fn_05 / nullif(fn_05 + tp_05, 0), 0), 8) AS fnr_05 FROM s, h",
    "scored",
)
def e2_binary_metrics(scored):
    return evaluation.binary_metrics(scored.withColumn("score", F.col("score").cast("double")))


@query(f"{_CURVE} SELECT max(recall) AS recall FROM curve WHERE fpr <= 0.3", "scored")
def e3_recall_under_fpr(scored):
    return evaluation.recall_under_fpr(evaluation.threshold_curve(scored.withColumn("score", F.col("score").cast("double"))), 0.3)


@query(
    f"{_CURVE}, m AS (SELECT threshold AS medium, fpr <= 0.3 AS met FROM curve ORDER BY fpr <= 0.3 DESC, f2 DESC, recall DESC, fpr, threshold LIMIT 1), h AS (SELECT min(threshold) AS h FROM curve, m WHERE threshold >= medium AND precision >= 0.9), b AS (SELECT threshold AS b FROM curve, m WHERE threshold >= medium ORDER BY precision DESC, recall DESC, threshold DESC LIMIT 1) SELECT medium, coalesce(h, b) AS high, CASE WHEN met THEN 'maximize_f2_subject_to_fpr_cap' ELSE 'fallback_maximize_f2_no_threshold_met_fpr_cap' END AS medium_rule, CASE WHEN h IS NULL THEN 'fallback_maximize_precision_target_unmet' ELSE 'lowest_threshold_meeting_precision_target' END AS high_rule FROM m, h, b",
    "scored",
)
def e4_select_thresholds(scored):
    return evaluation.select_risk_thresholds(evaluation.threshold_curve(scored.withColumn("score", F.col("score").cast("double"))), 0.3, 0.9)


@query(
    f"{_CURVE}, m AS (SELECT threshold AS medium, fpr <= -1 AS met FROM curve ORDER BY fpr <= -1 DESC, f2 DESC, recall DESC, fpr, threshold LIMIT 1), h AS (SELECT min(threshold) AS h FROM curve, m WHERE threshold >= medium AND precision >= 1.5), b AS (SELECT threshold AS b FROM curve, m WHERE threshold >= medium ORDER BY precision DESC, recall DESC, threshold DESC LIMIT 1) SELECT medium, coalesce(h, b) AS high, CASE WHEN met THEN 'maximize_f2_subject_to_fpr_cap' ELSE 'fallback_maximize_f2_no_threshold_met_fpr_cap' END AS medium_rule, CASE WHEN h IS NULL THEN 'fallback_maximize_precision_target_unmet' ELSE 'lowest_threshold_meeting_precision_target' END AS high_rule FROM m, h, b",
    "scored",
)
def e4_fallback_thresholds(scored):
    """Where no threshold meets the cap or the precision."""
    return evaluation.select_risk_thresholds(evaluation.threshold_curve(scored.withColumn("score", F.col("score").cast("double"))), -1.0, 1.5)


@query("SELECT id, CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM scored", "scored")
def e5_classify_band(scored):
    return evaluation.classify_band(scored, 0.35, 0.7).select("id", "band")


@query("SELECT id, round(p_fraudulent + p_suspicious / 2, 9) AS risk, abs(p_genuine + p_suspicious + p_fraudulent - 1) <= 1e-6 AS valid FROM scored3", "scored3")
def e6_risk_scalar(scored3):
    return evaluation.risk_scalar(scored3).select("id", "risk", "valid")


_GRID = (
    "+ g AS (SELECT s / 100 AS s, f / 100 AS f FROM range(5, 65, 5) a(s), range(40, 100, 5) b(f) WHERE f >= greatest(40, s + 5)), c AS (SELECT label, floor(round((p_fraudulent + p_suspicious / 2) * 20, 9)) AS c, count(*) AS n FROM scored3 GROUP BY ALL),"
    " p AS (SELECT s, f, label, n, CASE WHEN c >= round(f * 20, 6) THEN 'FRAUDULENT' WHEN c >= round(s * 20, 6) THEN 'SUSPICIOUS' ELSE 'GENUINE' END AS pred FROM c, g),"
    " k AS (SELECT s, f, c.c, coalesce(sum(n) FILTER (WHERE label = c.c AND pred = c.c), 0) AS tp, coalesce(sum(n) FILTER (WHERE label = c.c), 0) AS a, coalesce(sum(n) FILTER (WHERE pred = c.c), 0) AS b FROM p, (VALUES ('GENUINE'), ('SUSPICIOUS'), ('FRAUDULENT')) c(c) GROUP BY ALL),"
    " grid AS (SELECT s, f, round(sum(CASE WHEN a + b > 0 THEN 2 * tp / (a + b) ELSE 0 END) / 3, 8) AS macro_f1, round(max(CASE WHEN c = 'FRAUDULENT' THEN CASE WHEN a > 0 THEN tp / a ELSE 0 END END), 8) AS fraud_recall FROM k GROUP BY s, f)"
)


@query(
    f"{_GRID} SELECT * FROM grid",
    "scored3",
)
def e7_grid_thresholds(scored3):
    return evaluation.grid_thresholds(scored3)


@query(
    f"{_GRID} SELECT s AS suspicious, f AS fraudulent, macro_f1, fraud_recall FROM grid ORDER BY macro_f1 DESC, fraud_recall DESC, f, s LIMIT 1",
    "scored3",
)
def e7_choose_thresholds(scored3):
    return evaluation.choose_grid_thresholds(evaluation.grid_thresholds(scored3))


_BINS = "+ b AS (SELECT CAST(least(floor(score * 5), 4) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_rate, round(sum(pow(score - label, 2)), 6) AS squared_error FROM scored GROUP BY 1)"


@query(
    f"{_BINS} SELECT * FROM b",
    "scored",
)
def e9_calibration_bins(scored):
    return evaluation.calibration_bins(scored.withColumn("score", F.col("score").cast("double"))).withColumn("squared_error", F.round("squared_error", 6))


@query(
    f"{_BINS} SELECT round(sum(n * abs(mean_score - positive_rate)) / sum(n), 6) AS ece, round((SELECT avg(pow(score - label, 2)) FROM scored), 6) AS brier FROM b",
    "scored",
)
def e9_calibration_error(scored):
    return evaluation.calibration_error(evaluation.calibration_bins(scored.withColumn("score", F.col("score").cast("double"))))


@query(
    "+ t AS (SELECT label, greatest(p_genuine, p_suspicious, p_fraudulent) AS c, CASE WHEN p_genuine >= p_suspicious AND p_genuine >= p_fraudulent THEN 'GENUINE' WHEN p_suspicious >= p_fraudulent THEN 'SUSPICIOUS' ELSE 'FRAUDULENT' END AS pred,"
    " pow(p_genuine - CAST(label = 'GENUINE' AS INT), 2) + pow(p_suspicious - CAST(label = 'SUSPICIOUS' AS INT), 2) + pow(p_fraudulent - CAST(label = 'FRAUDULENT' AS INT), 2) AS e FROM scored3),"
    " b AS (SELECT least(floor(c * 5), 4) AS bin, count(*) AS n, round(avg(c), 6) AS mc, round(avg(CAST(label = pred AS INT)), 6) AS acc FROM t GROUP BY 1)"
    " SELECT round((SELECT avg(e) FROM t), 6) AS multiclass_brier, round(sum(n * abs(mc - acc)) / sum(n), 6) AS ece FROM b",
    "scored3",
)
def e9_multiclass_calibration(scored3):
    return evaluation.multiclass_calibration(scored3)


_REPORT = (
    "+ p AS (SELECT label, CASE WHEN p_fraudulent >= 0.4 THEN 'FRAUDULENT' WHEN p_suspicious >= 0.1 THEN 'SUSPICIOUS' ELSE 'GENUINE' END AS pred FROM scored3), c AS (SELECT DISTINCT label AS class FROM p UNION SELECT DISTINCT pred FROM p),"
    " k AS (SELECT class, (SELECT count(*) FROM p WHERE label = class AND pred = class) AS tp, (SELECT count(*) FROM p WHERE label = class) AS support, (SELECT count(*) FROM p WHERE pred = class) AS got FROM c),"
    " report AS (SELECT class, support, round(CASE WHEN got > 0 THEN tp / got ELSE 0 END, 8) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 8) AS recall, round(CASE WHEN got + support > 0 THEN 2 * tp / (got + support) ELSE 0 END, 8) AS f1 FROM k)"
)


def _confusion(scored3):
    p = F.when(F.col("p_fraudulent") >= 0.4, "FRAUDULENT").when(F.col("p_suspicious") >= 0.1, "SUSPICIOUS").otherwise("GENUINE")
    return evaluation.confusion(scored3.withColumn("pred", p), "label", "pred")


@query(f"{_REPORT} SELECT label, pred AS predicted, count(*) AS n FROM p GROUP BY ALL", "scored3")
def e10_confusion(scored3):
    return _confusion(scored3)


@query(f"{_REPORT} SELECT * FROM report", "scored3")
def e10_class_report(scored3):
    return evaluation.class_report(_confusion(scored3))


@query(f"{_REPORT} SELECT round(avg(f1), 6) AS macro_f1, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, CAST(sum(support) AS BIGINT) AS n_rows FROM report", "scored3")
def e10_report_summary(scored3):
    return evaluation.report_summary(evaluation.class_report(_confusion(scored3)))


# Evidence that both engines derive by the same text; lists are joined by commas.
_EVIDENCE = (
    "SELECT run_id, verification_status, CASE WHEN verification_status = 'MISMATCH' THEN CASE run_id % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'transaction_reference,amount' END END AS mm,"
    " run_id % 5 <> 0 AS sa, CASE risk_level WHEN 'HIGH' THEN 'FRAUDULENT' WHEN 'MEDIUM' THEN 'SUSPICIOUS' WHEN 'LOW' THEN 'GENUINE' END AS sc,"
    " CASE WHEN run_id % 10 = 0 THEN 'STRUCTURED_MODEL_DISABLED' ELSE 'MODEL_NOT_ACCEPTED,STRUCTURED_MODEL_DISABLED' END AS sr,"
    " run_id % 3 <> 0 AS ia, CASE WHEN duration_ms % 2 = 0 THEN 'tampered' ELSE 'genuine' END AS ic, CAST(duration_ms % 1000 AS DOUBLE) / 1000 AS score,"
    " CASE WHEN run_id % 2 = 0 THEN 'MODEL_NOT_ACCEPTED' ELSE 'IMAGE_MODEL_DISABLED,MODEL_NOT_ACCEPTED' END AS ir, status <> 'PARTIAL' AS fc,"
    " CASE run_id % 6 WHEN 0 THEN 'STATUS_UNKNOWN' WHEN 1 THEN 'TIMESTAMP_IN_FUTURE,STATUS_UNKNOWN' END AS sem,"
    " CASE run_id % 7 WHEN 0 THEN 'TIMESTAMP_IN_FUTURE,TEXT_OVERLAP' WHEN 1 THEN 'TEXT_OVERLAP' END AS img, CASE WHEN run_id % 9 = 0 THEN 'amount' END AS cf FROM runs"
)
_JUDGED = (
    f"+ e AS ({_EVIDENCE}), c AS (SELECT *, CASE WHEN sa THEN sc END AS cls, ia AND ic = 'tampered' AND score >= 0.85 AS t FROM e),"
    " b AS (SELECT *, CASE WHEN mm IS NOT NULL OR cls = 'FRAUDULENT' OR t THEN 'high_risk' WHEN cls = 'SUSPICIOUS' THEN 'medium_risk' WHEN cls = 'GENUINE' AND fc THEN 'low_risk' ELSE 'inconclusive' END AS band,"
    " CASE WHEN mm IS NOT NULL THEN CASE WHEN contains(mm, ',') THEN 'REFERENCE_AMOUNT_MISMATCH,REFERENCE_TRANSACTION_REFERENCE_MISMATCH' ELSE 'REFERENCE_AMOUNT_MISMATCH' END"
    " WHEN cls = 'FRAUDULENT' THEN 'STRUCTURED_MODEL_HIGH_RISK' WHEN t THEN 'IMAGE_MODEL_TAMPER_THRESHOLD_EXCEEDED' WHEN cls = 'SUSPICIOUS' THEN 'STRUCTURED_MODEL_MEDIUM_RISK'"
    " WHEN cls = 'GENUINE' AND fc THEN 'STRUCTURED_MODEL_LOW_RISK' ELSE 'INSUFFICIENT_EVIDENCE' END AS main FROM c),"
    " l AS (SELECT *, string_split(concat_ws(',', main, sem, img), ',') AS rs, string_split(concat_ws(',',"
    " CASE WHEN band = 'inconclusive' THEN CASE WHEN cls = 'GENUINE' THEN 'CRITICAL_OCR_FIELDS_INCOMPLETE' ELSE 'CONCLUSIVE_MODEL_EVIDENCE_UNAVAILABLE' END END,"
    " CASE WHEN band = 'inconclusive' AND NOT fc THEN 'CRITICAL_OCR_FIELDS_INCOMPLETE' END, CASE WHEN band = 'inconclusive' AND verification_status = 'UNVERIFIED' THEN 'REFERENCE_RECORD_UNAVAILABLE' END,"
    " CASE WHEN NOT ia THEN ir END, CASE WHEN NOT sa THEN sr END), ',') AS ms FROM b)"
)


def _judged(runs):
    e = runs.sparkSession.sql(_EVIDENCE.replace("FROM runs", "FROM {r}"), r=runs)
    words = lambda c: F.split(c, ",")
    reasons = lambda c: F.transform(words(c), lambda x: F.struct(x.alias("code"), F.lower(x).alias("title"), F.lit("LOW").alias("severity")))
    return evaluation.risk_policy(
        e.select(
            "run_id", "verification_status", words("mm").alias("critical_mismatches"), F.col("sa").alias("structured_available"), F.col("sc").alias("structured_class"), words("sr").alias("structured_reasons"),
            F.col("ia").alias("image_available"), F.col("ic").alias("image_class"), F.col("score").alias("image_score"), words("ir").alias("image_reasons"), F.col("fc").alias("fields_complete"),
            reasons("sem").alias("semantic_reasons"), reasons("img").alias("image_signals"), words("cf").alias("corrected_fields"),
        )
    )


@query(
    _JUDGED
    + " SELECT run_id, band, CASE band WHEN 'high_risk' THEN 'HIGH' WHEN 'medium_risk' THEN 'MEDIUM' WHEN 'low_risk' THEN 'LOW' END AS risk_class,"
    " CASE WHEN ia AND sa AND band <> 'inconclusive' THEN 'COMPLETED' ELSE 'PARTIAL' END AS status, array_to_string(list_filter(rs, lambda x, i: NOT list_contains(rs[i + 1:], x)), ',') AS reasons FROM l",
    "runs",
)
def e15_risk_policy(runs):
    return _judged(runs).select("run_id", "band", "risk_class", "status", F.array_join("reasons.code", ",").alias("reasons"))


@query(
    _JUDGED
    + " SELECT run_id, array_to_string(list_filter(ms, lambda x, i: list_position(ms, x) = i), ',') AS missing, concat_ws(',', CASE WHEN verification_status = 'VERIFIED' THEN 'STORED_REFERENCE_MATCH_NOT_AUTHENTICITY' END,"
    " CASE WHEN img IS NOT NULL THEN 'DETERMINISTIC_IMAGE_SUPPORTING_ONLY' END, CASE WHEN cf IS NOT NULL THEN 'CORRECTED_LOW_CONFIDENCE_FIELDS' END) AS limitations FROM l",
    "runs",
)
def e16_missing_signals(runs):
    return _judged(runs).select("run_id", F.array_join("missing_signals", ",").alias("missing"), F.array_join("limitations", ",").alias("limitations"))


@query(
    "+ f AS (SELECT run_id AS id, unnest(['risk:' || risk_level, 'status:' || status, 'verification:' || verification_status]) AS fact FROM runs), r AS (SELECT * FROM (VALUES ('R1', 'risk:HIGH', 40.0), ('R2', 'status:PARTIAL', 10.0), ('R3', 'verification:MISMATCH', 35.0)) t(rule_code, fact, c)), s AS (SELECT id, sum(c) AS score, string_agg(rule_code, ',' ORDER BY rule_code) AS rules FROM f JOIN r USING (fact) GROUP BY id) SELECT id, CAST(score AS DOUBLE) AS score, rules, CASE WHEN score >= 70 THEN 'BLOCK' WHEN score >= 35 THEN 'REVIEW' ELSE 'PASS' END AS outcome FROM s",
    "runs",
)
def e17_evaluate_rules(runs):
    facts = runs.select(F.col("run_id").alias("id"), F.explode(F.array(F.concat(F.lit("risk:"), "risk_level"), F.concat(F.lit("status:"), "status"), F.concat(F.lit("verification:"), "verification_status"))).alias("fact"))
    rules = runs.sparkSession.createDataFrame([("R1", "risk:HIGH", 40.0), ("R2", "status:PARTIAL", 10.0), ("R3", "verification:MISMATCH", 35.0)], "rule_code string, fact string, contribution double")
    return evaluation.evaluate_rules(facts, rules)


@query(
    "+ q AS (SELECT initiator_id AS principal, transaction_type AS scope, recipient_id AS key, CAST(row_no % 2 AS VARCHAR) AS hash, row_no AS seq FROM tx), w AS (SELECT *, first_value(hash) OVER (PARTITION BY principal, scope, key ORDER BY seq) AS fh, row_number() OVER (PARTITION BY principal, scope, key ORDER BY seq) AS k FROM q) SELECT seq, CASE WHEN k = 1 THEN 'FIRST' WHEN hash = fh THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM w",
    "tx",
)
def e18_idempotent_replay(tx):
    q = tx.select(F.col("initiator_id").alias("principal"), F.col("transaction_type").alias("scope"), F.col("recipient_id").alias("key"), (F.col("row_no") % 2).cast("string").alias("hash"), F.col("row_no").alias("seq"))
    return evaluation.idempotent_replay(q).select("seq", "outcome")


@query(
    "+ g AS (SELECT DISTINCT group_id, CAST(substr(group_id, 4) AS INT) % 2 = 0 AS controlled FROM manifest), k AS (SELECT *, row_number() OVER (PARTITION BY controlled ORDER BY sha256('42:' || group_id)) AS k, count(*) OVER (PARTITION BY controlled) AS n FROM g),"
    " r AS (SELECT DISTINCT controlled, n, unnest(CASE WHEN controlled THEN [0.7::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE] ELSE [0.8::DOUBLE, 0.2::DOUBLE, 0.0::DOUBLE] END) AS share, unnest([1, 2, 3]) AS i FROM k),"
    " f AS (SELECT *, floor(n * share) AS base, row_number() OVER (PARTITION BY controlled ORDER BY n * share - floor(n * share) DESC, i) AS rank, n - sum(floor(n * share)) OVER (PARTITION BY controlled) AS rest FROM r),"
    " q AS (SELECT controlled, sum(base + CASE WHEN rank <= rest THEN 1 ELSE 0 END) FILTER (WHERE i = 1) AS a, sum(base + CASE WHEN rank <= rest THEN 1 ELSE 0 END) FILTER (WHERE i = 2) AS b FROM f GROUP BY 1)"
    " SELECT group_id, k.controlled, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'validation' ELSE 'test' END AS split FROM k JOIN q ON k.controlled = q.controlled",
    "manifest",
)
def l2_group_hash_split(manifest):
    return governance.group_hash_split(manifest, "group_id", "42", F.expr("CAST(substr(group_id, 4) AS INT) % 2 = 0"))


@query("SELECT group_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n_splits FROM manifest GROUP BY 1 HAVING count(DISTINCT split) > 1", "manifest")
def a10_group_leakage(manifest):
    return governance.group_leakage(manifest)


@query("SELECT split, label, count(*) AS n, CAST(grouping(split, label) AS INT) AS level FROM manifest GROUP BY CUBE (split, label)", "manifest")
def a9_count_cube(manifest):
    return governance.count_cube(manifest)


@query("SELECT sha, count(*) AS n, CASE WHEN min(label) = max(label) THEN 'duplicate_sha256' ELSE 'conflicting_duplicate_labels' END AS code FROM manifest GROUP BY sha HAVING count(*) > 1", "manifest")
def a11_duplicate_label_conflicts(manifest):
    return governance.duplicate_label_conflicts(manifest)


@query("SELECT s AS split, CAST(x AS INT) AS label FROM (VALUES ('train'), ('validation'), ('test'), ('locked')) a(s), (VALUES (0), (1), (2)) b(x) WHERE (s, x) NOT IN (SELECT split, label FROM manifest)", "manifest")
def a12_class_coverage(manifest):
    return governance.class_coverage(manifest, ["train", "validation", "test", "locked"], [0, 1, 2])


@query("SELECT c.sample_id, CASE WHEN p.sample_id IS NULL THEN 'PARENT_MISSING' ELSE 'PARENT_CROSSES_GROUP_OR_SPLIT' END AS code FROM manifest c LEFT JOIN manifest p ON c.parent_id = p.sample_id WHERE c.parent_id IS NOT NULL AND (p.sample_id IS NULL OR p.group_id <> c.group_id OR p.split <> c.split)", "manifest")
def j10_parent_integrity(manifest):
    return governance.parent_integrity(manifest)


@query("SELECT sample_id FROM manifest WHERE group_id NOT IN (SELECT 'src' || CAST(range AS VARCHAR) FROM range(0, 20, 3))", "manifest")
def j8_exclude_withdrawn(manifest):
    ledger = manifest.where(F.expr("CAST(substr(group_id, 4) AS INT) % 3 = 0")).select("group_id").distinct()
    return governance.exclude_withdrawn(manifest, ledger, "group_id").select("sample_id")


@query("SELECT sample_id, CASE WHEN CAST(substr(group_id, 4) AS INT) % 3 <> 0 THEN sha END AS sha, CASE WHEN CAST(substr(group_id, 4) AS INT) % 3 = 0 THEN 'WITHDRAWN' ELSE 'ACTIVE' END AS state FROM manifest", "manifest")
def j9_propagate_withdrawal(manifest):
    ledger = manifest.where(F.expr("CAST(substr(group_id, 4) AS INT) % 3 = 0")).select("group_id").distinct()
    return governance.propagate_withdrawal(manifest, ledger, "group_id", ["sha"]).select("sample_id", "sha", "state")


# Two sides of the whole manifest: some keys are of one side only, some sizes differ.
_SIDE_A = "SELECT CASE WHEN source_type = 'fr' THEN 'a' || sha ELSE sha END AS sha, source_type, sample_id FROM manifest"
_SIDE_B = "SELECT CASE WHEN source_type = 'de' OR sample_id % 50 = 3 THEN 'b' || sha ELSE sha END AS sha, source_type, CASE WHEN sample_id % 50 = 4 THEN sample_id + 1 ELSE sample_id END AS sample_id FROM manifest"
_PAIRED = (
    f"+ a AS (SELECT lower(sha) AS k, min(source_type) AS c, max(sample_id) AS s FROM ({_SIDE_A}) GROUP BY 1), b AS (SELECT lower(sha) AS k, min(source_type) AS c, max(sample_id) AS s FROM ({_SIDE_B}) GROUP BY 1),"
    " j AS (SELECT coalesce(a.c, b.c) AS category, count_if(a.k IS NOT NULL AND b.k IS NOT NULL)::BIGINT AS paired, count_if(b.k IS NULL)::BIGINT AS missing, count_if(a.k IS NULL)::BIGINT AS orphan,"
    " count_if(coalesce(a.s <> b.s, false))::BIGINT AS size_mismatches FROM a FULL JOIN b ON a.k = b.k GROUP BY 1)"
)


def _sides(manifest):
    return [manifest.sparkSession.sql(x.replace("FROM manifest", "FROM {m}"), m=manifest) for x in (_SIDE_A, _SIDE_B)]


def _paired(manifest):
    a, b = _sides(manifest)
    return governance.paired_audit(a, b.withColumn("sha", F.concat(F.upper("sha"), F.lit(".png"))), "sha", "source_type", "sample_id", stem=True)


@query(f"{_PAIRED} SELECT * FROM j", "manifest")
def j13_paired_audit(manifest):
    return _paired(manifest)


@query(f"{_PAIRED}, w(category, want) AS (VALUES ('de', 0), ('en', 7), ('it', 1)) SELECT coalesce(j.category, w.category) AS category, CASE WHEN want IS NULL THEN 'UNEXPECTED_CATEGORY' WHEN paired IS NULL THEN 'CATEGORY_MISSING' ELSE 'COUNT_DRIFT' END AS reason FROM j FULL JOIN w ON j.category = w.category WHERE paired IS DISTINCT FROM want", "manifest")
def j13_paired_drift(manifest):
    return governance.paired_drift(_paired(manifest), {"de": 0, "en": 7, "it": 1})


@query(
    f"(SELECT sha, 'missing' AS side FROM ({_SIDE_A}) EXCEPT SELECT sha, 'missing' FROM ({_SIDE_B})) UNION ALL (SELECT sha, 'extra' FROM ({_SIDE_B}) EXCEPT SELECT sha, 'extra' FROM ({_SIDE_A}))",
    "manifest",
)
def d3_set_difference(manifest):
    return governance.set_difference(*_sides(manifest), "sha")


_ALLOWED = [("click", "view"), ("view", "click"), ("view", "purchase"), ("click", "click"), ("view", "view"), ("purchase", "view"), ("signup", "click")]


@query(
    "+ w AS (SELECT *, lag(to_state) OVER (PARTITION BY record_id ORDER BY seq) AS prev FROM state_events) SELECT record_id, seq, 'BROKEN_CHAIN' AS code FROM w WHERE from_state IS DISTINCT FROM prev UNION ALL SELECT record_id, seq, 'PAIR_NOT_ALLOWED' FROM w WHERE from_state IS NOT NULL AND (from_state || '>' || to_state) NOT IN ("
    + ", ".join(f"'{a}>{b}'" for a, b in _ALLOWED)
    + ") UNION ALL SELECT record_id, seq, 'APPROVED_WITHOUT_HISTORY' FROM w WHERE prev IS NULL AND to_state = 'purchase'",
    "state_events",
)
def w15_state_transitions(state_events):
    return governance.state_transition_audit(state_events, _ALLOWED, ["purchase"])


@query("SELECT sample_id FROM manifest WHERE group_id IN (SELECT DISTINCT group_id FROM manifest ORDER BY group_id LIMIT 5)", "manifest")
def t4_first_n_groups(manifest):
    return governance.first_n_groups(manifest, "group_id", 5).select("sample_id")


@query("SELECT run_id, (SELECT count(*) FROM runs) AS total, CAST(ceil((SELECT count(*) FROM runs) / 50.0) AS BIGINT) AS total_pages FROM runs ORDER BY duration_ms DESC, run_id DESC LIMIT 50 OFFSET 100", "runs")
def t1_page(runs):
    return governance.page(runs, 3, 50, [F.desc("duration_ms"), F.desc("run_id")]).select("run_id", "total", "total_pages")


@query("SELECT run_id FROM runs WHERE provider_code = 'MTN_MOMO' AND risk_level IS NULL AND status = 'PARTIAL'", "runs")
def f1_history_filter(runs):
    return governance.history_filter(runs, provider="MTN_MOMO", band="inconclusive").select("run_id")


@query("SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%12%' OR lower(c_mktsegment) LIKE '%auto%'", "customer")
def f2_search_filter(customer):
    return governance.search_filter(customer, "AUTO", ["c_mktsegment"]).select("c_custkey").union(governance.search_filter(customer, "12", ["c_name"]).select("c_custkey")).distinct()


@query(
    "+ d AS (SELECT * FROM runs WHERE completed_at >= TIMESTAMP '2024-01-03' AND completed_at < TIMESTAMP '2024-01-20'), c AS (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM runs WHERE verification_status = 'MISMATCH')"
    " SELECT provider_code, count(*) AS n_runs, count_if(risk_level = 'LOW')::BIGINT AS low, count_if(risk_level = 'MEDIUM')::BIGINT AS medium, count_if(risk_level = 'HIGH')::BIGINT AS high, count_if(risk_level IS NULL)::BIGINT AS inconclusive, count_if(status = 'PARTIAL')::BIGINT AS partial,"
    " count_if(verification_status = 'VERIFIED')::BIGINT AS verified, count_if(verification_status = 'MISMATCH')::BIGINT AS mismatch, count_if(verification_status = 'UNVERIFIED')::BIGINT AS unverified, round(avg(duration_ms), 4) AS mean_ms, round(quantile_cont(duration_ms, 0.95), 4) AS p95_ms,"
    " count_if(state = 'OPEN')::BIGINT AS cases_open, count_if(state = 'CLOSED')::BIGINT AS cases_closed FROM d LEFT JOIN c ON d.run_id = c.run_id GROUP BY 1",
    "runs",
)
def a21_operations_dashboard(runs):
    cases = runs.where("verification_status = 'MISMATCH'").select("run_id", F.when(F.col("run_id") % 2 == 0, "OPEN").otherwise("CLOSED").alias("state"))
    return governance.operations_dashboard(runs, cases, "2024-01-03", "2024-01-20")


@query(
    "SELECT nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS host, count(*) AS n_pages, count_if(NOT coalesce(regexp_matches(url, '^https://[^/@]+(/|$)'), false))::BIGINT AS not_https, count_if(coalesce(regexp_matches(url, '^[A-Za-z]+://[^/@]*@'), false))::BIGINT AS with_credentials,"
    " count_if(trim(coalesce(html, '')) = '')::BIGINT AS missing_pages, count(*) - count(DISTINCT coalesce(html, '')) AS duplicate_pages FROM pages GROUP BY 1",
    "pages",
)
def a24_candidate_sources(pages):
    return governance.candidate_source_report(pages)


# Status, content and rights of the pages as candidate sources: by their address and their markup.
_CANDIDATE = (
    "SELECT CASE WHEN url LIKE 'https://%' THEN 'verified' WHEN url LIKE 'http://%' THEN 'pending' END AS status,"
    " CASE WHEN html LIKE '%<article%' THEN 'article' ELSE 'other' END AS content,"
    " CASE WHEN url LIKE '%.example.com/%' THEN 'licensed' WHEN url LIKE '%.example.net/%' THEN 'permitted' WHEN page_id % 2 = 0 THEN 'unknown' END AS rights FROM pages"
)


@query(
    f"WITH c AS ({_CANDIDATE}) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM c GROUP BY {d}" for d in ("status", "content", "rights")),
    "pages",
)
def a24_source_counts(pages):
    d = pages.sparkSession.sql(_CANDIDATE.replace("FROM pages", "FROM {p}"), p=pages)
    return governance.candidate_source_counts(d, ["status", "content", "rights"])


# That engine cannot look around: where a pattern only has to be found, it consumes its neighbours instead.
_GATE = [p for k, p in messages.SENSITIVE if k in ("EMAIL", "PHONE", "MONEY")]
_FOUND = [p.replace(r"(?<!\d)", "(?:^|[^0-9])").replace(r"(?!\d)", "(?:[^0-9]|$)") for p in [*_GATE, *messages.RESIDUAL, messages.SECRET]]
_CUES = " OR ".join(f"contains(lower(text), '{c}')" for c in messages.CUES)
# A text of the view with numbered placeholders, and some that are none.
_PLACED = (
    "'[AMOUNT_001] to [ENTITY_' || lpad(CAST(record_id % 7 AS {0}), 3, '0') || '] [SHOP_001] [PHONE_12] ' || CAST(record_id AS {0}) || ' x' || CAST(record_id % 5 AS {0})"
    " || '  1.5 ' || chr(9) || '[REFERENCE_TEXT_004] ' || text"
)
_PLACEHOLDER = messages.PLACEHOLDER.replace("\\d", "[0-9]")


def _template(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(regexp_replace({text}, '{_PLACEHOLDER}', '[VALUE]', 'g')), '\b[0-9]+\b', '[NUMBER]', 'g'), '\s+', ' ', 'g'))"


@query(None, "msgs")
def m1_tokenize_sensitive(msgs):
    return messages.tokenize_sensitive(msgs).select("record_id", *(f"n_{k.lower()}" for k, _ in messages.SENSITIVE), "clean")


_LEFT = " OR ".join(f"regexp_matches(text, '{p}')" for p in _FOUND)


@query(f"SELECT record_id FROM msgs WHERE {_LEFT}", "msgs")
def m4_residual_gate(msgs):
    return messages.residual_gate(msgs, "text").select("record_id")


@query(f"SELECT doc_id FROM documents WHERE {_LEFT}", "documents")
def m4_document_gate(documents):
    """The gate over the texts alone, of which few are held."""
    return messages.residual_gate(documents, "text").select("doc_id")


@query(None, "msgs")
def m4_cleaned_gate(msgs):
    """What is left in the messages after their placeholders."""
    from ..operators import corpora

    return messages.residual_gate(corpora.numbered_placeholders(msgs.select("record_id", "text"))).select("record_id")


@query(None, "msgs")
def m5_identifier_categories(msgs):
    return msgs.select("record_id", messages.identifier_categories(F.col("text")).alias("categories"))


@query(f"SELECT record_id FROM msgs WHERE regexp_matches(text, '{messages.SECRET}')", "msgs")
def m6_secret_quarantine(msgs):
    return messages.secret_quarantine(msgs)[1].select("record_id")


@query(f"SELECT record_id, CASE WHEN {_CUES} THEN 'transaction_confirmation' ELSE 'official_service_message' END AS category FROM msgs", "msgs")
def m7_message_category(msgs):
    return msgs.select("record_id", messages.message_category(F.col("text")).alias("category"))


@query(f"SELECT record_id, 'GHMSGGROUP_' || upper(substr(sha256({_template(_PLACED.format('VARCHAR'))}), 1, 24)) AS template FROM msgs", "msgs")
def m8_plain_template(msgs):
    """The template of a text with placeholders of its own; that of the text as it is cleaned is m8_template_group."""
    return msgs.select("record_id", messages.template_group(F.expr(_PLACED.format("STRING"))).alias("template"))


@query(None, "msgs")
def m8_template_group(msgs):
    from ..operators import corpora

    return corpora.numbered_placeholders(msgs.select("record_id", "text")).select("record_id", messages.template_group(F.col("clean")).alias("template"))


@query("SELECT provider_family, min(record_id) AS first_id, count(*) AS occurrences FROM msgs GROUP BY provider_family, lower(text)", "msgs")
def m9_dedup_messages(msgs):
    return messages.dedup_messages(msgs)


@query("SELECT record_id, CASE WHEN regexp_matches(sender, '^[0-9]{3,6}$') THEN 'shortcode' WHEN regexp_matches(sender, '^\\+?[0-9]{9,15}$') THEN 'phone' WHEN regexp_matches(sender, '[A-Za-z]') THEN 'alphanumeric' ELSE 'unknown' END AS kind FROM msgs", "msgs")
def m11_sender_kind(msgs):
    return msgs.select("record_id", messages.sender_kind(F.col("sender")).alias("kind"))


@query(
    "+ x AS (SELECT record_id, list_distinct(regexp_extract_all(text, 'GHS ?([0-9]+(?:\\.[0-9]+)?)', 1)) AS a, nullif(regexp_extract(text, 'Transaction ID: ([A-Z]+[0-9]+)', 1), '') AS reference, nullif(regexp_extract(text, ' to (SHOP [0-9]+)', 1), '') AS recipient FROM msgs) SELECT record_id, reference, recipient, CASE WHEN len(a) = 1 THEN CAST(a[1] AS DECIMAL(18,2)) END AS amount, CASE WHEN len(a) = 1 THEN 'OK' WHEN len(a) = 0 THEN 'AMOUNT_NOT_FOUND' ELSE 'AMOUNT_AMBIGUOUS' END AS amount_code, CASE WHEN len(a) = 1 THEN 0.92::DOUBLE ELSE 0.25::DOUBLE END AS amount_confidence FROM x",
    "msgs",
)
def x1_x3_extract_fields(msgs):
    return messages.extract_fields(msgs).select("record_id", "reference", "recipient", "amount", "amount_code", "amount_confidence")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text, count(*) AS n_turns FROM conversations GROUP BY conv_id", "conversations")
def m13_assemble_text(conversations):
    return messages.assemble_text(conversations)


_FOLD = "trim(regexp_replace(lower(regexp_replace({}.text, '[^ -~\\n]', '?', 'g')), '[ \\t\\n\\r]+', ' ', 'g'))"


@query(f"SELECT a.conv_id, a.turn, round(levenshtein({_FOLD.format('a')}, {_FOLD.format('b')}) / greatest(length({_FOLD.format('a')}), 1), 6) AS cer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn", "conversations")
def x11_text_error_rate(conversations):
    """Characters beyond ASCII are replaced for the comparison with SQL; x11_error_rates has the texts as they are."""
    # The other engine counts bytes, so both texts are brought to one byte a character here.
    plain = F.regexp_replace("text", r"[^ -~\n]", "?")
    d = messages.next_turns(conversations.withColumn("text", plain))
    return d.select("conv_id", "turn", messages.text_error_rate(F.col("text"), F.col("other")).alias("cer"))


@query(None, "conversations")
def x11_error_rates(conversations):
    """Character and word error rates of each turn by the next one, over whole texts."""
    d = messages.next_turns(conversations)
    rates = {"cer": messages.text_error_rate(F.col("text"), F.col("other")), "wer": messages.word_error_rate(F.col("text"), F.col("other"))}
    return d.select("conv_id", "turn", *(v.alias(k) for k, v in rates.items()))


@query(None, "tx")
def causal_features(tx):
    d = causal.causal_features(tx)
    return d.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in d.dtypes))


@query("SELECT CASE WHEN regexp_matches(initiator_id, '^[=+@-]') THEN '''' || initiator_id ELSE initiator_id END AS initiator_id, CASE WHEN row_no % 2 = 0 THEN '''=' || recipient_id ELSE recipient_id END AS recipient_id, row_no FROM tx", "tx")
def s6_csv_safe(tx):
    from ..sources.tables import csv_safe

    risky = F.when(F.col("row_no") % 2 == 0, F.concat(F.lit("="), F.col("recipient_id"))).otherwise(F.col("recipient_id"))
    return csv_safe(tx.select("initiator_id", risky.alias("recipient_id"), "row_no"))


@query(None, "tx")
def s9_content_fingerprint(tx):
    from ..sources.tables import content_fingerprint

    return content_fingerprint(tx, ["row_no", "step", "amount", "initiator_id", "recipient_id"])


@query(
    "+ u AS (SELECT min(id) AS id, hi, lo FROM hashes GROUP BY hi, lo), n AS (SELECT b.id, min(a.id) AS near FROM u a JOIN u b ON a.id < b.id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6 GROUP BY 1), f AS (SELECT h.*, min(h.id) OVER (PARTITION BY hi, lo) AS first, near FROM hashes h LEFT JOIN n ON h.id = n.id)"
    " SELECT id, CASE WHEN id % 50 = 7 THEN 'withdrawn' WHEN id > first THEN 'exact_duplicate' WHEN near IS NOT NULL THEN 'near_duplicate' WHEN id % 9 = 0 THEN 'needs_deidentification' ELSE 'needs_transcription' END AS state, CASE WHEN id % 50 = 7 THEN NULL WHEN id > first THEN 'exact_duplicate_of:' || first WHEN near IS NOT NULL THEN 'near_duplicate_of:' || near END AS reason FROM f",
    "hashes",
)
def j20_intake_triage(hashes):
    return governance.intake_triage(hashes, hashes.where("id % 50 = 7"), references.near_counts(hashes, 6), working=hashes.where("id % 9 = 0"))


@query("SELECT c_custkey AS transaction_id, r.run_id, r.risk_level, r.status FROM customer LEFT JOIN (SELECT transaction_id, max(run_id) AS run_id, arg_max(coalesce(risk_level, '~'), run_id) AS rl, arg_max(status, run_id) AS status, nullif(rl, '~') AS risk_level FROM runs GROUP BY 1) r ON c_custkey = transaction_id", "customer", "runs")
def j7_latest_run_history(customer, runs):
    return governance.latest_run_history(customer.select(F.col("c_custkey").alias("transaction_id")), runs)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", "customer", "orders")
def j18_bridge_filter(customer, orders):
    roles = orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("role"))
    return governance.bridge_filter(customer, roles, "c_custkey", "1-URGENT").select("c_custkey")


@query("SELECT sample_id, b AS bucket, CASE WHEN b = 'owner' THEN 'train' WHEN split = 'test' AND b <> 'controlled' THEN 'train' ELSE split END AS split FROM (SELECT *, CASE source_type WHEN 'en' THEN 'controlled' WHEN 'fr' THEN 'owner' ELSE 'other' END AS b FROM manifest)", "manifest")
def l5_bucket_policy(manifest):
    return governance.bucket_policy(manifest, {"en": "controlled", "fr": "owner"}).select("sample_id", "bucket", "split")


@query(
    "SELECT row_no, CASE WHEN k <= n // 2 THEN 'first' ELSE 'second' END AS half FROM (SELECT row_no, row_number() OVER (ORDER BY step, row_no) AS k, count(*) OVER () AS n FROM tx)",
    "tx",
)
def l6_chronological_halves(tx):
    return governance.chronological_halves(tx, "step", "row_no").select("row_no", "half")


@query(
    "+ s AS (SELECT group_id FROM manifest GROUP BY 1 HAVING count(DISTINCT source_type) > 1), g AS (SELECT source_type, count(*) AS n, count(DISTINCT m.group_id) AS n_groups, count(DISTINCT label) AS n_labels, count(DISTINCT s.group_id) AS shared_groups FROM manifest m LEFT JOIN s ON m.group_id = s.group_id GROUP BY 1)"
    " SELECT *, concat_ws(',', CASE WHEN shared_groups > 0 THEN 'GROUP_IN_TWO_SOURCES' END, CASE WHEN n_labels < 2 THEN 'ONE_LABEL' END, CASE WHEN n_groups < CASE source_type WHEN 'en' THEN 21 ELSE 20 END THEN 'TOO_FEW_GROUPS' END, CASE WHEN n < CASE source_type WHEN 'en' THEN 200 ELSE 130 END THEN 'TOO_FEW_RECORDS' END) AS blockers FROM g",
    "manifest",
)
def a13_readiness(manifest):
    return governance.readiness(manifest, {"en": (200, 21)}, (130, 20))


@query("SELECT record_id, count(*) AS n FROM (SELECT record_id FROM msgs UNION ALL SELECT doc_id FROM labels) GROUP BY 1 HAVING count(*) > 1", "msgs", "labels")
def d1_union_corpora(msgs, labels):
    return governance.union_corpora({"messages": msgs, "labels": labels.withColumnRenamed("doc_id", "record_id")})[1]


_BOXES = "(SELECT 8 * length(word) AS width, 12 + length(word) % 3 AS height FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations))"


def _boxes(conversations):
    w = conversations.select(F.explode(F.split("text", " ", -1)).alias("word"))
    return w.select((8 * F.length("word")).alias("width"), (12 + F.length("word") % 3).alias("height"))


@query(
    f"SELECT count(*) AS n, count_if(width = 0 OR height = 0)::BIGINT AS no_size, count_if(greatest(width, height) > 90)::BIGINT AS above_cap, count_if(width * height > 900)::BIGINT AS oversized, concat_ws(',', CASE WHEN count_if(greatest(width, height) > 90) > 0 THEN 'DIMENSION_CAP_EXCEEDED' END, CASE WHEN count_if(width * height > 900) > 0 THEN 'OVERSIZED_ITEM' END, CASE WHEN count_if(width = 0 OR height = 0) > 0 THEN 'ZERO_DIMENSION' END) AS reasons FROM {_BOXES}",
    "conversations",
)
def a25_collection_profile(conversations):
    return governance.collection_profile(_boxes(conversations), 90, 900)


@query(f"SELECT width, height, count(*) AS n FROM {_BOXES} GROUP BY ALL", "conversations")
def a25_dimension_histogram(conversations):
    return governance.dimension_histogram(_boxes(conversations))


@query(
    "+ g AS (SELECT t / 100 AS t FROM range(5, 100, 5) a(t)), c AS (SELECT t, count(*) FILTER (WHERE label = 1 AND score >= t) AS tp, count(*) FILTER (WHERE label = 0 AND score >= t) AS fp, count(*) FILTER (WHERE label = 1 AND score < t) AS fn, count(*) FILTER (WHERE label = 0 AND score < t) AS tn FROM scored, g GROUP BY t) SELECT t, round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 8) AS mean_f1, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 8) AS recall FROM c",
    "scored",
)
def e8_binary_grid(scored):
    return evaluation.binary_grid(scored)


@query(
    "+ g AS (SELECT t / 100 AS t FROM range(5, 100, 5) a(t)), c AS (SELECT t, count(*) FILTER (WHERE label = 1 AND score >= t) AS tp, count(*) FILTER (WHERE label = 0 AND score >= t) AS fp, count(*) FILTER (WHERE label = 1 AND score < t) AS fn, count(*) FILTER (WHERE label = 0 AND score < t) AS tn FROM scored, g GROUP BY t),"
    " f AS (SELECT t, round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 8) AS mean_f1, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 8) AS recall FROM c)"
    " SELECT t AS threshold, mean_f1, recall FROM f ORDER BY mean_f1 DESC, recall DESC, t LIMIT 1",
    "scored",
)
def e8_choose_threshold(scored):
    return evaluation.choose_binary_threshold(evaluation.binary_grid(scored))
