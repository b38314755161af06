"""The queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hard_negatives, html_text, license_scan, line_dedup, periodic_runs, quality_rules, sharding, simhash_dedup, token_dictionary, toxicity
from ._common import LOWER, UPPER, delete_at_end, fenced, shared_dir, table, words_of

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
SHARDS = 24


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op3_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_dictionary.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("row")


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_dictionary.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}"  # a map of its own for each run, so that a result depends on the table alone
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS, folder)
    delete_at_end(spark, folder)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
        "longest_pos",
        "longest_item",
        "longest_item_pos",
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten by the crc32 of its id, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = fenced(docs.select("doc_id", "text"), h=h, g=F.floor(h / 10), w=F.when(h % 10 == 0, words_of(F.col("text"))))
    d = fenced(d, n=F.nullif(F.size("w").cast("long"), F.lit(0).cast("long")))  # null where there are no words
    d = fenced(d, a=F.col("g") % F.col("n"))
    d = fenced(d, p=1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    words = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", source(i).cast("int")))
    return d.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs.collapse_runs(planted_runs(table(spark, sf_dir, "documents")))
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    higher = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    best = F.reduce("runs", nothing, lambda a, x: F.when(higher(a, x), x).otherwise(a))
    line = lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))
    return d.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = html_text.extract(pages.select("page_id", "url", "html"), html_text.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepare(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_toxicity, op3_license_digest, op4_token_counts, op5_simhash_dedup, op6_chat_perspectives, op7_quality_rules, op8_bpe_encode_decode, op9_slot_sharding, op10_decontaminate, op11_periodic_runs, op12_html_text, op13_hard_negatives)
}

_B = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_B}), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.keeper AS dropped FROM k LEFT JOIN g ON k.key = g.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY r""",
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _line(x: str) -> str:
    out = rf"trim(regexp_replace(regexp_replace(lower({x}), {_quoted(license_scan.NUMBERING)}, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches(lower({x}), {_quoted(license_scan.COPYRIGHT)}) THEN '' ELSE {out} END"


def _spelled(x: str) -> str:
    out = x
    for spelling, form in license_scan.SPELLINGS.items():
        out = rf"regexp_replace({out}, '\b{spelling}\b', '{form}', 'g')"
    return f"CASE WHEN regexp_matches({x}, {_quoted(license_scan.ANY_SPELLING)}) THEN {out} ELSE {x} END"


_LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_line('x')}), lambda x: x <> '')"
SQL["op3_license_digest"] = f"""
WITH known(digest, license) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n, _ in license_scan.known_rows())}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_LINES} AS lines FROM documents),
e AS (SELECT r, doc_id, lines, coalesce(array_to_string(lines, ' '), '') AS whole FROM d),
w AS (SELECT r, doc_id, sha256({_spelled("whole")}) AS text_digest FROM e),
l AS (SELECT r, unnest(list_distinct(lines)) AS line FROM d),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT r, sha256({_spelled("line")}) AS digest FROM l) JOIN known USING (digest) GROUP BY r)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM w LEFT JOIN known ON text_digest = known.digest LEFT JOIN n ON w.r = n.r"""

_UNMARKED = r"regexp_replace({}, '<\|(im_start|im_end)\|>', '< |\1|>', 'g')"
SQL["op6_chat_perspectives"] = f"""
WITH s AS (SELECT conv_id, turn, replace({_UNMARKED.format("coalesce(role, 'system')")}, chr(10), ' ') AS who, {_UNMARKED.format("coalesce(text, '')")} AS said, floor(turn / {chat_format.BLOCK}) AS block FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM s WHERE who <> 'system'),
x AS (SELECT s.*, speaker, who = speaker AS own, '{chat_format.START}' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || who END || chr(10) AS head FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, length(head) + length(said) + 11 AS size, sum(length(head) + length(said) + 11) OVER w AS e, row_number() OVER w AS n FROM x WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, said ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, CAST(min(e - size) OVER (PARTITION BY conv_id, speaker, block) AS BIGINT) // {chat_format.SEGMENT_CHARS} AS part FROM y),
v AS (SELECT *, CAST(min(e - size) OVER (PARTITION BY conv_id, speaker, part) AS BIGINT) AS start FROM z)
SELECT conv_id, speaker, CAST(part AS INT) AS segment, any_value(start) AS start, count(*) AS n_turns, string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY n) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(e - start - length(said) - 11 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(e - start AS BIGINT) AS VARCHAR) END, ',' ORDER BY n), '') AS mask
FROM v GROUP BY conv_id, speaker, part"""

SQL["op7_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
t AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM g, range(0, 3) x(k) WHERE n > 1 GROUP BY r),
b AS (SELECT d.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {_B}) <> '')) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x, {_B}) <> ''))) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat, 0) AS n_repeat_words FROM d LEFT JOIN c ON d.r = c.r),
l AS (SELECT r, source, md5(line) AS line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT r, source, unnest(list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: trim(x, {_B})), lambda x: x <> '')) AS line FROM d)),
f AS (SELECT l.source, line, count(DISTINCT md5(text)) AS k FROM l JOIN d ON l.r = d.r GROUP BY l.source, line HAVING count(DISTINCT md5(text)) >= {quality_rules.LINE_DOCS}),
h AS (SELECT source, count(DISTINCT md5(text)) AS n_host FROM d GROUP BY source),
x AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_removed FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source JOIN h ON h.source IS NOT DISTINCT FROM f.source WHERE f.k >= {quality_rules.LINE_SHARE} * n_host GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(n_removed, 0) AS n_removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(n_removed, 0) >= {quality_rules.KEEP_SHARE} * n_words AS kept
FROM b LEFT JOIN x ON b.r = x.r"""

SQL["op13_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u AS au, a.vec_id AS anchor_id, b.u, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.u <> b.u),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id, u) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.au, p.u ORDER BY s.score DESC, s.vec_id, s.u) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.au = s.au AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""
