"""Text functions, and what is built on them, against the plain versions of Python."""

import hashlib
import random
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkledger.functions import text
from sparkledger.operators import extraction, records, references

SF = "/root/testdata/sf0.001"
PAIRS = [("ama mensah", "ama mensa"), ("ama mensah", "mensah ama"), ("abc", "xyz"), ("", "a"), ("", ""), ("same", "same"), (None, "a"), ("a", None), ("qabxcd", "abycdf"), ("x" * 300, "x" * 299 + "y")]


def test_sequence_ratio(spark):
    d = spark.createDataFrame([(k, *p) for k, p in enumerate(PAIRS)], "k int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = d.select("k", text.sequence_ratio(a, b).alias("r"), text.sequence_similar(a, b, 0.9).alias("s")).collect()
    for k, r, s in got:
        x, y = PAIRS[k]
        want = None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
        assert r == pytest.approx(want) and s == (None if want is None else want >= 0.9)


def test_compatibility_form(spark):
    raw = ["plain  text ", "ﬁne Ａ１  x", "²½ é é", "\n\t", "", None]
    d = spark.createDataFrame(list(enumerate(raw)), "k int, t string")
    for k, a, b in d.select("k", text.nfkc(F.col("t")), text.clean_text(F.col("t"))).collect():
        n = None if raw[k] is None else unicodedata.normalize("NFKC", raw[k])
        assert a == n and b == (None if n is None else " ".join(n.split()))


def test_compatibility_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text.to_dict()
    want = {k: " ".join(unicodedata.normalize("NFKC", t).split()) for k, t in docs.items()}
    got = {r.doc_id: (r.n_chars, r.digest) for r in entry.queries()["u3_compatibility_form"](spark, SF).collect()}
    assert got == {k: (len(t), hashlib.md5(t.encode()).hexdigest()) for k, t in want.items()}


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Reference: AB123 456 done 789", {"AB123", "AB123456"}),
        ("Transaction ID: MP 1234 5678", {"MP1234", "MP12345678"}),
        ("reference: abcde fghij", set()),
        ("call 0241234567 or x-12/9", {"0241234567", "X-12/9"}),
        ("Ｒｅｆ: ＡＢ１２３４５", {"AB12345"}),
        ("x" * 60 + "1", set()),
        ("one12345\r\ntwo12345 three123", {"ONE12345", "TWO12345", "THREE123"}),
        ("", set()),
        (None, set()),
    ],
)
def test_reference_spans(spark, said, want):
    d = spark.createDataFrame([(1, said)], "k int, text string")
    assert {r.span for r in extraction.reference_spans(d, "k").collect()} == want


def test_names_are_compared_by_sequence(spark):
    columns = ["amount", "currency", "sender_phone", "receiver_phone", "sender_name", "receiver_name", "occurred_at", "transaction_status"]
    row = [1, "GHS", "p", "q", "AMA MENSA", "", "2024-01-01 00:00:00", "S"]
    # Two letters more: a sequence ratio of 0.9, and a Levenshtein ratio of 0.82.
    other = [*row[:4], "AMA MENSAHA", "KOFI", *row[6:]]
    obs = spark.createDataFrame([("o", *row)], ["observation_id", *columns])
    refs = spark.createDataFrame([("r", *other)], ["ref_id", *columns])
    resolved = spark.createDataFrame([("o", "r")], ["observation_id", "ref_id"])
    got = {r.field: r.status for r in references.compare_fields(obs, refs, resolved).collect()}
    assert got["sender_name"] == "MATCH" and got["receiver_name"] == "NOT_AVAILABLE" and got["amount"] == "MATCH"


def test_reference_rows_are_read_in_compatibility_form(spark):
    columns = ["provider_code", "transaction_reference", "amount", "currency", "sender_name", "sender_phone", "receiver_phone", "occurred_at", "transaction_status"]
    rows = [(" mtn　momo ", "ＡＢ 123 456", "１,200.50", "ghs", " : Ama  Mensah -", "0241234567", None, "2024-01-02  10:20", "completed"), (None,) * 9]
    a, b = records.canonicalize_references(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))).collect()
    assert (a.provider_code, a.transaction_reference, str(a.amount), a.currency, a.sender_name, a.transaction_status) == ("MTN_MOMO", "AB123456", "1200.50", "GHS", "AMA MENSAH", "SUCCESSFUL")
    assert a.errors == "" and a.occurred_at is not None and len(b.errors.split(",")) == 6


def table_of_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_by_blocks_equal_the_table():
    """A sequence longer than a block is put together from its blocks."""
    draw = random.Random(7)
    for k in range(2000):
        a, b = ("".join(draw.choice("abé😀"[: 2 + k % 3]) for _ in range(draw.randint(0, 14))) for _ in range(2))
        for block in (1, 2, 5, 1 << 12):
            assert text._distance(a, b, block) == text._distance(list(b), list(a), block) == table_of_edits(a, b)


def test_edits_of_texts_and_of_words(spark):
    rows = [("abc d", "abd  d"), ("", ""), ("", "é"), ("😀x", "x😀"), ("same", "same"), (None, "a"), ("a", None)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string")
    words = lambda c: F.split(c, " ")
    for k, c, w in d.select("k", text.edits(F.col("a"), F.col("b")), text.edits(words("a"), words("b"))).collect():
        x, y = rows[k]
        assert (c, w) == ((None, None) if None in rows[k] else (table_of_edits(x, y), table_of_edits(x.split(" "), y.split(" "))))
