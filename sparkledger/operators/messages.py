"""Message corpora: sensitive tokens, categories, template groups, field extraction."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edits

# Sensitive patterns in the order of replacement, as the reference has them. Read by unicode().
SENSITIVE = [
    ("URL", r"(?i)\b(?:https?://|www\.)\S+"),
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("PHONE", r"(?<!\d)(?:\+?233[\s-]?|0)(?:2|5)\d(?:[\s-]?\d){7}(?!\d)"),
    ("MONEY", r"(?i)(?:GHS|GHC|GH[₵¢])\s*\d[\d,]*(?:\.\d{1,4})?"),
    ("REFERENCE", r"(?<![A-Za-z0-9])(?=[A-Za-z0-9-]{8,}\b)(?=[A-Za-z0-9-]*\d)[A-Za-z0-9-]+"),
]
# What every match of a kind holds one of, in lower case.
KINDS = [k for k, _ in SENSITIVE]
MARKS = {"URL": ["://", "www."], "EMAIL": ["@"], "MONEY": ["gh"]}
# What a residual gate looks for besides e-mail, phone and money.
RESIDUAL = [
    r"(?i)\b\d[\d,]*(?:\.\d{1,4})?\s*(?:GHS|GHC|GH₵|GH¢)\b",
    r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    r"(?<!\d)\d{4}[-/]\d{1,2}[-/]\d{1,2}(?!\d)",
    r"(?<!\d)(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?!\d)",
    r"\[[A-Z_]+_\d*\[",
]
#: Pairs of characters that a task compares.
TASK_WORK = 1 << 28
# Fixed value: a numbered placeholder.
PLACEHOLDER = r"\[(?:ENTITY|URL|EMAIL|PHONE|AMOUNT|REFERENCE|REFERENCE_TEXT|TIMESTAMP)_\d{3}\]"
#: Noncharacters that stand for a match, or for its ends, while a text is rewritten.
MARK, OPEN, SHUT = "\ufdd0", "\ufdd1", "\ufdd2"
# Identifier categories.
CATEGORIES = [
    ("phone_number", r"(?<!\d)(?:\+?233|0)[235]\d{8}(?!\d)"),
    ("email_address", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("transaction_reference", r"(?i)\b(?:reference|transaction[_ ]?id)\s*[:=]\s*(?!DEMO-|SYNTH-|REDACTED)[A-Z0-9-]{8,}"),
    ("personal_name", r"(?i)\b(?:customer|recipient|sender|name)\s*[:=]\s*(?!DEMO\b|SYNTHETIC\b|REDACTED\b|ANONYMOUS\b)[A-Z][A-Z'-]+(?:\s+[A-Z][A-Z'-]+)+"),
]
SECRET = (
    r"(?is)(?:\b(?:otp|one[ -]?time password|verification code|security code|pin is|code is|following code)\b.{0,300}?\b\d{4,8}\b"
    r"|\b\d{4,8}\b.{0,100}?\b(?:otp|one[ -]?time password|verification code|security code)\b)"
)
# Cue phrases of a transaction confirmation.
CUES = [
    "payment made", "payment received", "payment for", "cash out", "cash in", "money transfer", "airtime recharge", "successfully purchased", "transaction id",
    " confirmed.", "bundle purchase request", "transaction failed", "you bought", "you have received", "you have withdrawn", "fee charged", "reversal",
]
PROVIDERS = {"MTN_MOMO": r"(?i)mtn|momo", "TELECEL_CASH": r"(?i)telecel|vodafone", "AIRTELTIGO_MONEY": r"(?i)airteltigo|tigo cash"}


def unicode(pattern: str) -> str:
    """The pattern with classes, cases and word ends of Unicode, as the reference reads it."""
    return f"(?U){pattern}"


def marked(c: Column, kind: str, pattern: str, to: str) -> Column:
    """c with the matches of a kind's pattern replaced by to, in one run of the pattern; texts without what all matches hold
    are left out."""
    new = F.regexp_replace(c, unicode(pattern), to)
    if kind in MARKS:
        return F.when(F.exists(F.array(*map(F.lit, MARKS[kind])), lambda x: F.contains(F.lower(c), x)), new).otherwise(c)
    return F.when(c.rlike(unicode(r"\d")), new).otherwise(c)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)  # noqa: PLW0108  (f may have arguments with defaults)


def tokenize_sensitive(df: DataFrame, text: str = "text") -> DataFrame:
    """Each kind replaced by its token, in order; counts are of the text as the earlier kinds left it.

    A pattern runs once a text: its matches become a mark that no text has (a noncharacter), which is counted and replaced."""
    state = F.struct(F.col(text).alias("clean"))
    for kind, pattern in SENSITIVE:

        def step(s: Column, kind: str = kind, pattern: str = pattern) -> Column:
            return bound(
                marked(s["clean"], kind, pattern, MARK),
                lambda m: F.struct(
                    F.replace(m, F.lit(MARK), F.lit(f"[{kind}]")).alias("clean"),
                    *(s[f"n_{k.lower()}"].alias(f"n_{k.lower()}") for k, _ in SENSITIVE[: KINDS.index(kind)]),
                    (F.length(m) - F.length(F.replace(m, F.lit(MARK), F.lit("")))).cast("long").alias(f"n_{kind.lower()}"),
                ),
            )

        state = bound(state, step)
    names = [f"n_{k.lower()}" for k in KINDS]
    own = [c for c in df.columns if c != "clean"]
    d = df.select(*own, F.inline(F.array(state)).alias("clean", *names))
    return d.select(*own, *names, "clean")


def residual_gate(df: DataFrame, text: str = "clean") -> DataFrame:
    """The rows of cleaned text that still hold an e-mail address, a phone number, money, a one-time code, an address, a date or
    a time, or a broken placeholder. Links and long references are no part of it."""
    kinds = dict(SENSITIVE)
    hit = F.lit(False)
    for p in [kinds["EMAIL"], kinds["PHONE"], kinds["MONEY"], *RESIDUAL, SECRET]:
        hit = hit | F.col(text).rlike(unicode(p))
    return df.where(hit)


def identifier_categories(c: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when((F.upper(c) if k == "personal_name" else c).rlike(unicode(p)), k) for k, p in CATEGORIES))), ",")


def has_secret(c: Column) -> Column:
    return c.rlike(unicode(SECRET))


def secret_quarantine(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    return df.where(~has_secret(F.col(text))), df.where(has_secret(F.col(text)))


def message_category(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.exists(F.array(*map(F.lit, CUES)), lambda x: F.contains(low, x)), "transaction_confirmation").otherwise("official_service_message")


def template_text(c: Column) -> Column:
    """Placeholders as [VALUE], numbers that are words as [NUMBER], lower case, single spaces."""
    out = F.regexp_replace(c, PLACEHOLDER, "[VALUE]")
    out = F.regexp_replace(F.lower(out), unicode(r"\b\d+\b"), "[NUMBER]")
    return F.trim(F.regexp_replace(out, unicode(r"\s+"), " "))


def template_group(c: Column) -> Column:
    return F.concat(F.lit("GHMSGGROUP_"), F.upper(F.substring(F.sha2(template_text(c), 256), 1, 24)))


def sender_kind(c: Column) -> Column:
    return (
        F.when(c.rlike("^[0-9]{3,6}$"), "shortcode").when(c.rlike(r"^\+?[0-9]{9,15}$"), "phone").when(c.rlike("[A-Za-z]"), "alphanumeric").otherwise("unknown")
    )


def dedup_messages(df: DataFrame) -> DataFrame:
    """(provider_family, first_id, occurrences) for each different lower-case text of a provider."""
    return df.groupBy("provider_family", F.sha2(F.lower("text"), 256).alias("h")).agg(F.min("record_id").alias("first_id"), F.count("*").alias("occurrences")).drop("h")


def extract_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """amount, reference and recipient with their confidences; an amount is used only where one different value is found."""
    c = F.col(text)
    raw = F.array_distinct(F.regexp_extract_all(c, F.lit(r"GHS ?([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    d = df.withColumns({"amounts": raw, "reference": F.nullif(F.regexp_extract(c, r"Transaction ID: ([A-Z]+[0-9]+)", 1), F.lit("")), "recipient": F.nullif(F.regexp_extract(c, r" to (SHOP [0-9]+)", 1), F.lit(""))})
    one = F.size("amounts") == 1
    return d.withColumns(
        {
            "amount": F.when(one, F.get("amounts", F.lit(0)).cast("decimal(18,2)")),
            "amount_code": F.when(one, "OK").when(F.size("amounts") == 0, "AMOUNT_NOT_FOUND").otherwise("AMOUNT_AMBIGUOUS"),
            "amount_confidence": F.when(one, F.lit(0.92)).otherwise(F.lit(0.25)),
        }
    ).drop("amounts")


def assemble_text(turns: DataFrame) -> DataFrame:
    """Turns to one text for each conversation, in order."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_turns"))


def _folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r]+", " "))


def text_error_rate(truth: Column, read: Column) -> Column:
    """Character edits over the characters of truth (1 at the least), to 6 digits; null where a side is null."""
    a, b = _folded(truth), _folded(read)
    return F.round(edits(a, b) / F.greatest(F.length(a), F.lit(1)), 6)


def word_error_rate(truth: Column, read: Column) -> Column:
    """Word edits over the words of truth (1 at the least), to 6 digits; null where a side is null."""
    words = lambda c: F.array_remove(F.split(_folded(c), " "), "")
    a, b = words(truth), words(read)
    return F.round(edits(a, b) / F.greatest(F.size(a), F.lit(1)), 6)


def next_turns(turns: DataFrame) -> DataFrame:
    """turns with other, the text of the conversation's next turn, dealt to tasks by the work of comparing the two.

    That work is the product of the two lengths, however few bytes the turns have, so it is summed up from the lengths first
    (a job, while the plan is built). A pair of texts is never parted."""
    pairs = lambda d, c: d.join(d.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col(c).alias("other")), ["conv_id", "turn"])
    size = turns.select("conv_id", "turn", F.length("text").cast("double").alias("size"))
    n, work = pairs(size, "size").agg(F.count("*"), F.sum(F.col("size") * F.col("other"))).first()
    return pairs(turns, "text").repartition(max(1, min(n, math.ceil((work or 0) / TASK_WORK))))
