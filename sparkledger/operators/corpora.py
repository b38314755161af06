"""Message corpora as tables: intake, de-identification, review, reports and group splits."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ranking import running
from .messages import OPEN, RESIDUAL, SENSITIVE, SHUT, bound, marked, sender_kind, tokenize_sensitive, unicode
from .transactions import codes

# What is replaced by placeholders, in order, as the reference has it: kind, pattern, and the group that is the value
# (0: all of it).
PLACEHOLDERS = [
    ("REFERENCE_TEXT", r"(?is)(\brefer\w*\s*:\s*)(.+?)(?=\.\s*(?:financial\s+)?transaction\s+id\b|\.\s*download\s+the\s+momo\s+app\b)", 2),
    ("REFERENCE", r"(?is)(\b(?:financial\s+|external\s+)?transaction\s+id\s*:\s*)(.+?)(?=\.\s*(?:external\s+transaction\s+id|transaction\s+fee|download\s+the\s+momo\s+app|cash-out\s+fee|fee\s+charged|tax\s+charged)|$)", 2),
    ("ENTITY", r"^((?i:Y'?ello|Hello)[,!]?\s+)([A-Z][A-Z'-]+(?:\s+[A-Z][A-Z'-]+){1,5})(,\s+)", 2),
    ("ENTITY", r"^((?i:Hello),\s+)([A-Z][A-Z'-]+(?:\s+[A-Z][A-Z'-]+){1,5})(,\s+)", 2),
    ("ENTITY", r"^([A-Z][A-Za-z'-]{2,})(,\s+)", 1),
    ("ENTITY", r"\b([A-Z][A-Za-z']+(?:\s+(?:TO\s+)?[A-Z][A-Za-z']+){1,5})[\s,]+(?=(?:\+?233[\s-]?|0)(?:2|5)\d)", 1),
    ("ENTITY", r"(?i)\b([A-Z][A-Z' .-]{2,}?)(\s+has sent\b)", 1),
    ("ENTITY", r"(?i)(\b(?:to|from)\s+)(.+?)(?=(?:\s*[.,])?\s+(?:current\s+balance|available\s+balance|balance|transaction\s+id|fee\s+charged|token\b|thank\s+you\b|on\s+(?:mtn|mobilemoney)\b))", 2),
    *((kind if kind != "MONEY" else "AMOUNT", pattern, 0) for kind, pattern in SENSITIVE if kind != "REFERENCE"),
    ("AMOUNT", RESIDUAL[0], 0),
    *((kind, pattern, 0) for kind, pattern in SENSITIVE if kind == "REFERENCE"),
    ("REFERENCE", RESIDUAL[1], 0),
    ("TIMESTAMP", RESIDUAL[2], 0),
    ("TIMESTAMP", RESIDUAL[3], 0),
]
# First words of a message that are no name.
SALUTATIONS = ["hello", "yello", "y'ello", "congratulations"]
_FIELDS = "array<struct<name: string, raw: string, placeholder: string>>"
APPROVED = ["approved", "approved_with_edits"]
#: In the order in which a label's missing splits are filled.
SPLITS = ("test", "validation", "train")


def numbered_placeholders(df: DataFrame, text: str = "text") -> DataFrame:
    """df with clean, fields and leaks: sensitive values replaced by numbered placeholders; null stays null, with no fields.

    The patterns run one after the other over what the earlier ones left. A match becomes a span between two noncharacters,
    at which the text is cut into pieces: every second one is a value. A value gets the number of its first occurrence
    among those of its kind, in any case; the text is put together again from the pieces and the placeholders. In the end
    whatever is left of a value of three characters or more is replaced too, longer values first; leaks is whether one is
    left after all. All of it is built-in functions."""
    start = F.trim(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\0"), F.lit(" ")))
    state = F.struct(F.regexp_replace(start, unicode(r"^\s+|\s+$"), "").alias("clean"), F.array().cast(_FIELDS).alias("fields"))
    d = _step(df, state)
    for kind, pattern, group in PLACEHOLDERS:
        d = _step(d, _replaced(F.col("__s"), kind, pattern, group))
    d = _step(d, _swept(F.col("__s")))
    there, names = F.col(text).isNotNull(), ["clean", "fields", "leaks"]
    d = d.select(*(c for c in df.columns if c not in names), F.when(there, F.col("__s.clean")).alias("clean"), F.col("__s.fields").alias("fields"), _left(F.col("__s")).alias("leaks"))
    return d


def _step(d: DataFrame, state: Column) -> DataFrame:
    """d with its state in __s, as a row of its own: the optimizer copies no step into the next."""
    return d.select(*(c for c in d.columns if c != "__s"), F.inline(F.array(F.struct(state.alias("__s")))))


def _replaced(s: Column, kind: str, pattern: str, group: int) -> Column:
    """The state after one pattern: its matches' values numbered and replaced."""
    n = re.compile(pattern).groups
    if kind == "ENTITY" and pattern.startswith("^([A-Z]"):
        pattern = rf"^(?!(?i:{'|'.join(SALUTATIONS)}),){pattern[1:]}"
    value = f"{OPEN}${group}{SHUT}"
    spaced = r"[\s,]+(?=" in pattern  # a name before a number: what parts them becomes one space
    whole = "".join(value if k == group else f"${k}" for k in range(1, n + 1)) if group else value
    to = whole + " " * spaced
    new = F.regexp_replace(s["clean"], unicode(pattern), to) if group else marked(s["clean"], {"AMOUNT": "MONEY"}.get(kind, kind), pattern, to)

    def numbered(pieces: Column) -> Column:
        raw = lambda x: F.regexp_replace(x, unicode(r"^\s+|\s+$"), "") if group else x
        values = F.transform(F.filter(pieces, lambda x, i: i % 2 == 1), raw)

        def add(fields: Column, v: Column) -> Column:
            of_kind = F.filter(fields, lambda f: f["name"] == kind.lower())
            known = F.exists(of_kind, lambda f: F.lower(f["raw"]) == F.lower(v))
            name = F.format_string(f"[{kind}_%03d]", F.size(of_kind) + 1)
            one = F.struct(F.lit(kind.lower()).alias("name"), v.alias("raw"), name.alias("placeholder"))
            return F.when(known, fields).otherwise(F.concat(fields, F.array(one)))

        def rebuilt(fields: Column) -> Column:
            own = lambda x: F.filter(fields, lambda f: (f["name"] == kind.lower()) & (F.lower(f["raw"]) == F.lower(raw(x))))
            parts = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, own(x)[0]["placeholder"]).otherwise(x))
            return F.struct(F.array_join(parts, "").alias("clean"), fields.alias("fields"))

        return bound(F.aggregate(values, s["fields"], add), rebuilt)

    return bound(new, lambda t: F.when(F.contains(t, F.lit(OPEN)), numbered(F.split(t, f"[{OPEN}{SHUT}]"))).otherwise(s))


def _swept(s: Column) -> Column:
    """The state with what is left of each value replaced by its placeholder, longer values first."""
    at = F.transform(F.filter(s["fields"], lambda f: F.length(F.trim(f["raw"])) >= 3), lambda f, i: F.struct((-F.length(f["raw"])).alias("n"), i.alias("i"), f.alias("f")))
    literal = lambda x: F.concat(F.lit(r"(?iu)\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    put = lambda t, x: F.when(F.contains(F.lower(t), F.lower(x["f"]["raw"])), F.regexp_replace(t, literal(x["f"]["raw"]), x["f"]["placeholder"])).otherwise(t)
    return F.struct(F.aggregate(F.array_sort(at), s["clean"], put).alias("clean"), s["fields"].alias("fields"))


def _left(s: Column) -> Column:
    return F.exists(s["fields"], lambda f: (F.length(F.trim(f["raw"])) >= 3) & F.contains(F.lower(s["clean"]), F.lower(f["raw"])))


def mask_known_fields(df: DataFrame, text: str, values: str, key: str) -> DataFrame:
    """(key, clean, codes): the record's listed values (array of strings) replaced, longest first; VALUE_MISSING where one is
    not in the text, VALUE_LEAKS where one is left after all."""
    full = F.array_sort(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.length(v) > 0), lambda a, b: F.length(b) - F.length(a))
    d = df.select(key, F.coalesce(text, F.lit("")).alias("__t"), full.alias("__v"))
    clean = F.aggregate("__v", F.col("__t"), lambda acc, v: F.replace(acc, v, F.lit("[MASKED]")))
    d = d.withColumn("clean", clean)
    missing = F.exists("__v", lambda v: ~F.contains(F.col("__t"), v))
    leaks = F.exists("__v", lambda v: F.contains(F.replace(F.col("clean"), F.lit("[MASKED]"), F.lit("")), v))
    return d.select(key, "clean", F.array_join(codes(VALUE_LEAKS=leaks, VALUE_MISSING=missing), ",").alias("codes"))


def normalize_sms(sms: DataFrame, senders: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, counts). sms has address, body, type (1: incoming) and date (epoch milliseconds). Only incoming messages of
    listed senders stay, once each by identity; counts has one row of what was left out."""
    provider = F.lit(None).cast("string")
    for s, p in senders.items():
        provider = F.when(F.lower(F.trim("address")) == s.lower(), p).otherwise(provider)
    d = sms.withColumn("provider_family", provider)
    known, incoming = F.col("provider_family").isNotNull(), F.coalesce(F.col("type") == 1, F.lit(False))
    kept = d.where(known & incoming).withColumns({"sent_at_utc": F.timestamp_millis("date"), "identity": F.sha2(F.concat_ws("\u001f", "provider_family", F.col("date").cast("string"), "body"), 256)})
    rows = kept.groupBy("identity").agg(F.min("provider_family").alias("provider_family"), F.min("sent_at_utc").alias("sent_at_utc"), F.min("body").alias("body"), F.count("*").alias("copies"))
    counts = d.agg(F.count_if(~known).alias("unknown_sender"), F.count_if(known & ~incoming).alias("not_incoming"), F.count_if(known & incoming).alias("kept"))
    return rows, counts


def index_messages(df: DataFrame, source_hash: str, row_no: str, text: str = "text", sender: str = "sender") -> DataFrame:
    """Messages of some text with id, sender kind, tokenised text and counts of replacements."""
    d = tokenize_sensitive(df.where(F.trim(F.coalesce(text, F.lit(""))) != ""), text)
    mid = F.concat(F.lit("MSG-"), F.upper(F.substring(F.sha2(F.concat(F.lit(source_hash + ":"), F.col(row_no).cast("string")), 256), 1, 16)))
    return d.withColumns({"message_id": mid, "sender_kind": sender_kind(F.coalesce(sender, F.lit("")))})


def authenticity_boundary(df: DataFrame, senders: list[str], service: str, provenance: str) -> tuple[DataFrame, DataFrame]:
    """(authentic, quarantined): a listed sender (in any case), an incoming message of the service and of the provenance; a null
    counts as none of these."""
    listed = F.lower(F.trim("sender")).isin([s.strip().lower() for s in senders])
    ok = F.coalesce(listed & F.col("incoming") & (F.col("service") == service) & (F.col("source_provenance") == provenance), F.lit(False))
    return df.where(ok), df.where(~ok)


def eligible_for_training(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eligible, violations): approved and eligible rows; those without a working hash are violations."""
    ok = df.where(F.col("workflow_state").isin(APPROVED) & F.col("training_eligible"))
    return ok.where(F.col("working_sha256").isNotNull()), ok.where(F.col("working_sha256").isNull())


def apply_review_decisions(rows: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(reviewed rows, violations (key, code)). Each row needs one decision, by another reviewer than its first one."""
    one = decisions.groupBy(key).agg(F.count("*").alias("n"), F.min("decision").alias("review_decision"), F.min("reviewer").alias("second_reviewer"))
    d = rows.join(one, key, "full_outer")
    undecided, unknown = F.col("n").isNull(), F.col("first_reviewer").isNull()
    bad = codes(DECIDED_TWICE=F.coalesce(F.col("n") > 1, F.lit(False)), SAME_REVIEWER=F.coalesce(F.col("first_reviewer") == F.col("second_reviewer"), F.lit(False)), UNDECIDED=undecided, UNKNOWN_ID=unknown)
    d = d.withColumn("__c", bad)
    return d.where(F.size("__c") == 0).drop("__c", "n"), d.select(key, F.explode("__c").alias("code"))


def attach_index(source: DataFrame, index: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined rows, violations (key, code)): by row number; missing and repeated index rows are violations."""
    n = index.groupBy(key).agg(F.count("*").alias("n"))
    d = source.select(key, F.lit(1).alias("s")).join(n, key, "full_outer")
    code = F.when(F.col("n").isNull(), "INDEX_MISSING").when(F.col("n") > 1, "INDEX_REPEATED").when(F.col("s").isNull(), "SOURCE_MISSING")
    once = n.where("n = 1").select(key)
    return source.join(index.join(once, key, "left_semi"), key), d.select(key, code.alias("code")).where(F.col("code").isNotNull())


def state_report(df: DataFrame) -> DataFrame:
    """One row: records, pending ones, exact and near duplicates, withdrawn ones; state is the workflow state."""
    s = F.col("state")
    return df.agg(F.count("*").alias("n"), F.count_if(s.startswith("needs_")).alias("pending"), F.count_if(s == "exact_duplicate").alias("exact"), F.count_if(s == "near_duplicate").alias("near"), F.count_if(s == "withdrawn").alias("withdrawn"))


def annotation_report(df: DataFrame) -> DataFrame:
    """(annotation_state, label, n): records by state of annotation, approved ones by label too."""
    label = F.when(F.col("annotation_state") == "approved", F.col("label"))
    return df.groupBy("annotation_state", label.alias("label")).agg(F.count("*").alias("n"))


def corpus_report(df: DataFrame, secret: Column, category: Column, group: Column) -> DataFrame:
    """One row: raw messages, excluded ones, different texts, template groups, providers, confirmations among the rest."""
    d = df.select("text", "provider_family", secret.alias("x"), category.alias("c"), group.alias("g"))
    kept = ~F.col("x")
    return d.agg(
        F.count("*").alias("raw"), F.count_if("x").alias("excluded"), F.count_distinct(F.when(kept, F.sha2(F.lower("text"), 256))).alias("deduplicated"),
        F.count_distinct(F.when(kept, F.col("g"))).alias("template_groups"), F.count_distinct("provider_family").alias("providers"), F.count_if(kept & (F.col("c") == "transaction_confirmation")).alias("confirmations"),
    )


def quotas(n: Column, ratios: list[float]) -> list[Column]:
    """Largest-remainder shares of n; equal remainders go to the earlier share."""
    raw = [n * F.lit(r) for r in ratios]
    base = [F.floor(x) for x in raw]
    rest = [a - b for a, b in zip(raw, base, strict=True)]
    left = n - sum(base[1:], base[0])
    ahead = [sum(((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int") for j in range(len(ratios)) if j != i) for i in range(len(ratios))]
    return [b + (a < left).cast("int") for a, b in zip(ahead, base, strict=True)]


def stratified_group_split(df: DataFrame, ratios: list[float], seed: str) -> DataFrame:
    """(group_id, labels, n_rows, split): groups of one set of labels in hash order, cut at that stratum's quotas.

    A stratum of any number of groups is counted through in parts (ranking.running)."""
    g = df.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), "|").alias("labels"), F.count("*").alias("n_rows"))
    g = g.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "labels", F.lit(":"), "group_id"), 256))
    k = running(g, [F.col("h")], {"k": F.lit(1)}, ["labels"])
    q = quotas(F.col("n"), ratios)
    d = k.join(k.groupBy("labels").agg(F.count("*").alias("n")), "labels")
    return d.select("group_id", "labels", "n_rows", F.when(F.col("k") <= q[0], "train").when(F.col("k") <= q[0] + q[1], "validation").otherwise("test").alias("split"))


def repair_label_coverage(split: DataFrame, labels: list[str], seed: str) -> DataFrame:
    """Every label of three or more groups gets a group in each split: label by label, a split without it takes the group of
    fewest labels, then rows, then smallest hash, from a split that has more than one.

    split is as stratified_group_split returns it. There are three moves a label at most, and no move needs more than the
    first groups of a label in a split: those, 27 times the square of the number of labels at most, and the counts by
    label and split come to the driver in two jobs, where the moves are chosen one after the other."""
    split = stored(split)
    named = F.split("labels", r"\|")
    have = split.select("*", F.explode(F.array_intersect(named, F.array(*map(F.lit, labels)))).alias("x"))
    counts: dict[str, Counter] = {x: Counter() for x in labels}
    for r in have.groupBy("x", "split").agg(F.count("*").alias("n")).collect():
        counts[r["x"]][r["split"]] = r["n"]
    to = have.select("*", F.explode(F.array(*map(F.lit, SPLITS))).alias("to")).where("to <> split")
    ahead = [F.size(named), F.col("n_rows"), F.sha2(F.concat_ws(":", F.lit(f"{seed}:controlled-move"), "x", "to", "group_id"), 256)]
    best = to.withColumn("k", F.row_number().over(Window.partitionBy("x", "split", "to").orderBy(*ahead))).where(F.col("k") <= 3 * len(labels))
    first: dict[tuple, list] = defaultdict(list)
    for r in best.select("x", "split", "to", "group_id", "labels", "n_rows").collect():
        first[r["x"], r["split"], r["to"]].append((r["group_id"], r["labels"].split("|"), r["n_rows"]))
    moved: dict[str, tuple] = {}  # group: (split, labels, rows)
    for x in sorted(labels):
        for missing in SPLITS:
            if counts[x].total() < 3 or counts[x][missing]:
                continue
            donors = [s for s in SPLITS if counts[x][s] > 1]
            there = [(*g, s) for s in donors for g in first[x, s, missing] if g[0] not in moved]
            there += [(g, own, n, s) for g, (s, own, n) in moved.items() if s in donors and x in own]
            if not there:
                raise ValueError(f"no group of label {x} can move to {missing}")
            g, own, n, s = min(there, key=lambda t: (len(t[1]), t[2], sha256(f"{seed}:controlled-move:{x}:{missing}:{t[0]}".encode()).hexdigest()))  # noqa: B023
            moved[g] = missing, own, n
            for y in own:
                if y in counts:
                    counts[y][s] -= 1
                    counts[y][missing] += 1
    if not moved:
        return split
    rows = [(g, s) for g, (s, _, _) in moved.items()]
    new = split.sparkSession.createDataFrame(rows, "group_id string, __to string")
    out = split.join(F.broadcast(new), "group_id", "left").withColumn("split", F.coalesce("__to", "split")).drop("__to")
    return out.select(split.columns)


def hash_group_split(df: DataFrame, seed: str) -> DataFrame:
    """(group_id, split): 60, 20 and 20 % of the different groups in hash order, one each at the least."""
    g = df.select("group_id").distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "group_id"), 256))
    n = g.agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.bround(F.count("*") * 0.2)).alias("q"))
    d = running(g, [F.col("h")], {"k": F.lit(1)}).crossJoin(F.broadcast(n))
    return d.select("group_id", F.when(F.col("k") <= F.col("n") - 2 * F.col("q"), "train").when(F.col("k") <= F.col("n") - F.col("q"), "validation").otherwise("test").alias("split"))
