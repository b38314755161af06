"""Receipt fields of the service and reference times, by the rules written out in plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkledger.operators import extraction, references

CASES = {
    "tab": "Reference\t:\tABC12345\nStatus:\tsuccess",
    "cedi": "MTN MoMo\nAmount GH₵12.50\nTime: 2024-01-02 10:20:30+02:00",
    "wide": "Ｔｅｌｅｃｅｌ Cash\nTOTAL   GHS 1,234.50\nSender name:  : kofi  Annan -\nSender MSISDN 024 123 4567\nDate/Time 02/01/2024  09:05",
    "plain": "nothing to be found here",
    "odd": "Paid 5.00 REF#x-1\nTo phone: 12 34 56 78 90 1\nDate 2024-02-30 10:20\nRecipient name: 4711",
    "empty": "",
    "none": None,
}


@pytest.fixture(scope="module")
def fields(spark):
    d = extraction.extract_receipt_fields(spark.createDataFrame(list(CASES.items()), "k string, text string"), "k")
    return {(r["k"], r["field"]): (r["raw"], r["value"], r["masked"], r["warnings"]) for r in d.collect()}


def test_each_receipt_has_ten_fields(fields):
    assert len(fields) == 10 * len(CASES)


@pytest.mark.parametrize(
    "key, field, raw, value, warnings",
    [
        ("tab", "transaction_reference", "ABC12345", "ABC12345", ""),
        ("tab", "status_text", "success", "SUCCESSFUL", ""),
        ("tab", "provider_code", None, "GENERIC_MOMO", "UNKNOWN_TEMPLATE_GENERIC_FALLBACK,FIELD_NOT_FOUND"),
        ("cedi", "amount", "12.50", "12.50", ""),
        ("cedi", "currency", "GH₵", "GHS", ""),
        ("odd", "currency", None, "GHS", "CURRENCY_INFERRED_GHS,FIELD_NOT_FOUND"),
        ("cedi", "occurred_at", "2024-01-02 10:20:30+02:00", "2024-01-02T08:20:30Z", ""),
        ("cedi", "provider_code", "MTN MOMO", "MTN_MOMO", ""),
        ("wide", "provider_code", "TELECEL CASH", "TELECEL_CASH", ""),
        ("wide", "amount", "1,234.50", "1234.50", ""),
        ("wide", "currency", "GHS", "GHS", ""),
        ("wide", "sender_name", "kofi Annan -", "KOFI ANNAN", ""),
        ("wide", "sender_phone", "024 123 4567", "+233241234567", ""),
        ("wide", "occurred_at", "02/01/2024 09:05", "2024-01-02T09:05:00Z", "TIMEZONE_INFERRED_GHANA_UTC"),
        ("odd", "occurred_at", "2024-02-30 10:20", None, "DATE_TIME_INVALID,FIELD_FORMAT_INVALID"),
        ("odd", "receiver_phone", "12 34 56 78 90 1", None, "FIELD_FORMAT_INVALID"),
        ("odd", "receiver_name", "4711", None, "FIELD_FORMAT_INVALID"),
        ("odd", "transaction_reference", None, None, "FIELD_NOT_FOUND"),
        ("plain", "amount", None, None, "FIELD_NOT_FOUND"),
        ("empty", "currency", None, None, "FIELD_NOT_FOUND"),
        ("none", "status_text", None, None, "FIELD_NOT_FOUND"),
    ],
)
def test_service_fields(fields, key, field, raw, value, warnings):
    got = fields[key, field]
    assert (got[0], got[1], got[3]) == (raw, value, warnings)


def test_masks(fields):
    assert fields["wide", "sender_phone"][2] == "+233241 *** 4567" and fields["wide", "sender_name"][2] is None


def test_review(spark):
    rows = [("d", "amount", "1 2", "1", True, "", None), ("d", "currency", None, "GHS", True, "", None), ("d", "status_text", "x", None, False, "", None), ("d", "provider_code", "MTN", "MTN_MOMO", True, "", 0.75)]
    f = spark.createDataFrame(rows, "doc string, field string, raw string, value string, valid boolean, warnings string, provider_confidence double")
    tokens = spark.createDataFrame([("d", "1", 60.0), ("d", "(2)", 80.0), ("d", "X", 99.0)], "doc string, text string, confidence double")
    got = {r["field"]: (r["confidence"], r["requires_review"]) for r in extraction.reviewed_fields(f, tokens).collect()}
    assert got == {"amount": (0.8, False), "currency": (0.0, True), "status_text": (0.99, True), "provider_code": (0.75, False)}


def test_receipts_with_their_words_are_reviewed_in_their_rows(spark):
    """As the join of fields and tokens has it, also for odd words and numbers; the join's plan shuffles and stores."""
    from sparkledger.fixtures import view
    from sparkledger.plans import extraction as plans

    texts = {**CASES, "twice": "Paid 5.00 5.00 (5.00) MTN 500\nSender name: ß é Ama", "two": "To phone: 0241 234 567  0241\nGHS 12.50 12,50"}
    d = spark.createDataFrame([*texts.items(), (None, texts["cedi"])], "k string, text string")
    number = lambda k: F.when(k % 5 != 3, ((k * 7 + 13) % 101).cast("double"))
    tokens = d.select(F.col("k").alias("doc"), F.posexplode(F.split("text", "[ \n]+")).alias("pos", "text")).select("doc", "text", number(F.col("pos")).alias("confidence"))
    want = extraction.reviewed_fields(extraction.extract_receipt_fields(d, "k").withColumnRenamed("k", "doc"), tokens).collect()
    numbers = F.transform(F.split("text", "[ \n]+"), lambda w, k: number(k))
    got = extraction.reviewed_receipts(d, "k", F.regexp_replace("text", "[ \n]+", "\n"), numbers).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len({r["confidence"] for r in got}) > 9
    plan = plans.x14_reviewed_fields(view(spark, "/root/testdata/sf0.001", "receipts"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "scratch-" not in plan


def utc(*x):
    return dt.datetime(*x)


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-02 10:20:30", utc(2024, 1, 2, 10, 20, 30)), ("2024-1-2 9:5", utc(2024, 1, 2, 9, 5)), ("02/01/2024 10:20:30", utc(2024, 1, 2, 10, 20, 30)), ("2/1/2024 10:20", utc(2024, 1, 2, 10, 20)),
        ("02-01-2024 10:20:30", utc(2024, 1, 2, 10, 20, 30)), ("02-01-2024 10:20", utc(2024, 1, 2, 10, 20)), ("2024-01-02T10:20:30Z", utc(2024, 1, 2, 10, 20, 30)),
        ("2024-01-02T10:20:30.5-0130", utc(2024, 1, 2, 11, 50, 30, 500_000)), ("20240102T102030+02", utc(2024, 1, 2, 8, 20, 30)), ("2024-01-02", utc(2024, 1, 2)),
        ("02/01-2024 10:20", None), ("31/31/2001 10:20", None), ("2024-02-30 10:20", None), ("2024-01-02 25:20", None), ("2024-01-02 10:20+25:00", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_times(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(references.occurred_at(F.col("t"))["at"].alias("at")).first()
    assert (r["at"] and r["at"].replace(tzinfo=None)) == want


def test_plans_that_read_fields_twice_read_them_stored(spark):
    from sparkledger.fixtures import view
    from sparkledger.plans import extraction as plans

    d = plans.p11_diff_confirmed(view(spark, "/root/testdata/sf0.001", "receipts"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and d.count() > 0
