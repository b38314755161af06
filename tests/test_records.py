"""Extraction, corpus, record, model and stream operators on small literal rows."""

import hashlib
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkledger.fixtures import view
from sparkledger.operators import corpora, extraction, messages, models, records
from sparkledger.plans import catalog
from sparkledger.streaming import streams


SF = "/root/testdata/sf0.001"


def one(df):
    return df.collect()[0].asDict()


def receipts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_parse_receipt(spark):
    text = "MTN MoMo\nTransaction ID: AB12345\nAmount: GHS 1,234.50\nRecipient: Ama Mensah on 3 May\nWallet: 024 123 4567\nDate: 14/03/2024 09:05\nStatus: completed"
    p = one(extraction.parse_receipts(receipts(spark, text)))
    assert (p["provider"], p["amount"], p["reference"], p["recipient"], p["wallet"], p["status"]) == ("MTN_MOMO", "1234.50", "AB12345", "AMA MENSAH", "+233241234567", "successful")
    assert p["timestamp"] == "2024-03-14 09:05:00" and p["timestamp_warning"] is None
    assert round(p["provider_confidence"], 6) == 0.86


def test_parse_ambiguities(spark):
    d = extraction.parse_receipts(receipts(spark, "GHS 5 and GHS 6 failed reversed, at 03/04/2024 10:00, call 0241234567 or 0501234567", "", None)).orderBy("id")
    a, b, c = d.collect()
    assert a["amount"] is None and a["amount_warning"] == "AMOUNT_AMBIGUOUS"
    assert a["status_warning"] == "STATUS_CONFLICT" and a["wallet_warning"] == "WALLET_AMBIGUOUS"
    assert a["timestamp_warning"] == "DATE_ORDER_AMBIGUOUS_DAY_FIRST_USED" and a["timestamp"] == "2024-04-03 10:00:00"
    for x in (b, c):
        assert x["reference_warning"] == "REFERENCE_NOT_FOUND" and x["amount"] is None and x["status"] == "unknown" and x["provider"] == "UNKNOWN"


def test_labelled_pool_hides_the_other(spark):
    d = extraction.amount_pools(receipts(spark, "Amount: GHS 10 fee GHS 2"))
    assert [str(x) for x in one(d)["active"]] == ["10.00"]


def test_engine_confidence_and_inconclusive(spark):
    d = receipts(spark, "Reference: XX9911 Amount: GHS 10").withColumn("e", F.lit(0.5))
    p = extraction.parse_receipts(d, engine="e")
    r = one(p.withColumn("bad", extraction.inconclusive(p)))
    assert r["amount_confidence"] == pytest.approx(0.65 * 0.92 + 0.35 * 0.5) and r["bad"]


def test_overlaps_equal_brute_force(spark):
    boxes = [(d, n % 3, n, float(n * 37 % 200), 50.0 + n % 7, float(n * 11 % 90), 10.0 + n % 5) for d in (1, 2) for n in range(40)]
    t = spark.createDataFrame(boxes, "doc int, line int, pos int, x double, width double, y double, height double")
    want = {}
    for i, a in enumerate(boxes):
        for b in boxes[i + 1 :]:
            if a[0] == b[0] and a[1] != b[1] and a[3] < b[3] + b[4] and b[3] < a[3] + a[4] and a[5] < b[5] + b[6] and b[5] < a[5] + a[6]:
                want[a[0]] = want.get(a[0], 0) + 1
    assert {r.doc: r.overlaps for r in extraction.overlap_count(t, 32.0).collect()} == want


def test_boxes_in_cells_are_not_broadcast(spark):
    t = spark.createDataFrame([(1, n % 2, n, 9.0 * n, 50.0, 0.0, 10.0) for n in range(4)], "doc int, line int, pos int, x double, width double, y double, height double")
    d = extraction.overlap_count(t)
    assert [tuple(r) for r in d.collect()] == [(1, 4)]
    assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()


def test_numbered_placeholders(spark):
    texts = [
        "Pay GHS 5 to a@b.com, again A@B.COM, call 0241234567",
        None,
        "",
        "Hello, AMA MENSAH, payment received for GH₵ 20.00 from KOFI ANNAN Current Balance: 7 GHS. Transaction ID: 123456789. Fee charged: 0",
        "Kwame, you paid Yaw Boateng 024 123 4567 on 2024-01-02 at 10:20:30 via 10.0.0.1. Ref AB-12345678",
        "Congratulations, ama has sent you 5 GHS; reference: rent of May. Financial Transaction Id: 99.",
    ]
    rows = corpora.numbered_placeholders(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    assert [r["clean"] for r in rows] == [
        "Pay [AMOUNT_001] to [EMAIL_001], again [EMAIL_001], call [PHONE_001]",
        None,
        "",
        "Hello, [ENTITY_001], payment received for [AMOUNT_001] from [ENTITY_002] Current Balance: [AMOUNT_002]. Transaction ID: [REFERENCE_001]. Fee charged: 0",
        "[ENTITY_001], you paid [ENTITY_002] [PHONE_001] on [REFERENCE_001] at [TIMESTAMP_001] via [REFERENCE_003]. Ref [REFERENCE_002]",
        rows[5]["clean"],
    ]
    assert len(rows[0]["fields"]) == 3 and rows[1]["fields"] == [] and "rent of May" not in rows[5]["clean"] and "99" not in rows[5]["clean"] and rows[5]["clean"].startswith("Congratulations,")


def placed(text):
    """Placeholders by the rule: pattern after pattern, a value's number is that of its first occurrence among its kind."""
    if text is None:
        return None, [], False
    text, numbers, order = text.replace("\0", " ").strip(), {}, []
    for kind, pattern, group in corpora.PLACEHOLDERS:
        out, at = [], 0
        for m in re.finditer(pattern, text):
            value = m[group].strip() if group else m[0]
            if pattern.startswith("^([A-Z]") and value.lower() in corpora.SALUTATIONS:
                continue
            if (kind, value.lower()) not in numbers:
                numbers[kind, value.lower()] = sum(k == kind for k, _ in numbers) + 1
                order.append((kind, value))
            out += [text[at : m.start(group)], f"[{kind}_{numbers[kind, value.lower()]:03d}]"]
            at = m.end(group)
            if pattern.endswith("(?:2|5)\\d)"):
                out.append(" ")
                at = m.end()
        text = "".join(out) + text[at:]
    long = sorted((v for v in order if len(v[1].strip()) >= 3), key=lambda v: -len(v[1]))
    for kind, value in long:
        text = re.sub(re.escape(value), f"[{kind}_{numbers[kind, value.lower()]:03d}]", text, flags=re.I)
    fields = [(k.lower(), v, f"[{k}_{numbers[k, v.lower()]:03d}]") for k, v in order]
    return text, fields, any(v.lower() in text.lower() for _, v in long)


def test_placeholders_equal_the_rule(spark):
    parts = [
        "Hello, AMA MENSAH, ", "Y'ello KOFI ANNAN ADU, ", "Kwame, ", "Congratulations, ", "payment received from Yaw Boateng 024 123 4567 ", "to SHOP ONE. Current Balance: 7 GHS ", "ama has sent you GHS 20.00, ",
        "GH₵ 1,200.5 or 30 GHC ", "mail a@b.com A@B.COM ", "www.shop.gh/x?id=1 ", "Transaction ID: 123456789. Fee charged: 0 ", "external transaction id: AB-1 ", "Reference: rent of May. Financial transaction id 5. ",
        "on 2024-01-02 at 10:20:30 ", "via 10.0.0.1 ", "ref ab-12345678 ", "\0", "Ünï 0501234567, 0501234567 ", "$1 \\E [x] (y) ", "from GHS 20.00 token ", "123456789 ", "AMA mensah again ",
    ]
    rng = random.Random(3)
    texts = ["".join(rng.sample(parts, rng.randint(1, 9))) for _ in range(300)] + [None, "", " \t ", "GHS 5 " * 40, " ".join(f"GHS {k}" for k in range(1100))]
    d = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "id int, text string, fields int").repartition(4)
    for r in corpora.numbered_placeholders(d).collect():
        assert (r["clean"], [tuple(f) for f in r["fields"]], r["leaks"]) == placed(texts[r["id"]]), texts[r["id"]]


def test_template_groups(spark):
    rows = ["Pay [AMOUNT_001]  to\t[ENTITY_012] 15 abc12 1.5 [SHOP_001] [PHONE_1]", None]
    d = spark.createDataFrame([(t,) for t in rows], "t string").select(messages.template_text(F.col("t")).alias("x"), messages.template_group(F.col("t")).alias("g")).collect()
    want = "pay [value] to [value] [NUMBER] abc12 [NUMBER].[NUMBER] [shop_001] [phone_1]"
    assert d[0]["x"] == want and d[0]["g"] == "GHMSGGROUP_" + hashlib.sha256(want.encode()).hexdigest()[:24].upper() and d[1]["x"] is None


def test_receipt_patterns_of_the_reference(spark):
    texts = [
        "Amount: GH₵ 20.00\nRecipient:\nAMA\nRef:\tAB12345",
        "You sent GHC 5 to Kofi on Monday\nDate: 2024-01-02T10:20Z\nMTN",
        "GHS 5.000 then ₵7 received",
        "paid GH¢ 1, total GHS 2.00",
        "Telecel Cash and MTN\nwallet 024 123 4567",
    ]
    d = extraction.parse_receipts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    r = {x["id"]: x for x in d.collect()}
    assert (r[0]["amount"], r[0]["recipient"], r[0]["reference"]) == ("20.00", "AMA", "AB12345")
    assert (r[1]["amount"], r[1]["recipient"], r[1]["timestamp"], r[1]["provider"]) == ("5.00", "KOFI", "2024-01-02 10:20:00", "MTN_MOMO")
    assert (r[2]["amount"], r[2]["amount_confidence"]) == ("7.00", 0.92)
    assert r[3]["amount"] is None and r[3]["amount_warning"] == "AMOUNT_AMBIGUOUS"
    assert (r[4]["provider"], r[4]["provider_warning"], r[4]["wallet"]) == ("UNKNOWN", "PROVIDER_ANCHORS_CONFLICT,TEMPLATE_UNKNOWN", "+233241234567")


def test_mask_known_fields(spark):
    d = spark.createDataFrame([(1, "Ama Mensah sent Ama", ["Ama", "Ama Mensah"]), (2, "nothing", ["Kofi"]), (3, None, None)], "id int, text string, v array<string>")
    got = {r.id: (r.clean, r.codes) for r in corpora.mask_known_fields(d, "text", "v", "id").collect()}
    assert got == {1: ("[MASKED] sent [MASKED]", ""), 2: ("nothing", "VALUE_MISSING"), 3: ("", "")}


@pytest.mark.parametrize("n", range(1, 24))
def test_quotas_add_up(spark, n):
    ratios = [0.7, 0.15, 0.15]
    got = spark.range(1).select(*(q.cast("int").alias(f"q{k}") for k, q in enumerate(corpora.quotas(F.lit(n), ratios)))).first()
    raw = [n * r for r in ratios]
    want = [int(x) for x in raw]
    for k in sorted(range(3), key=lambda k: (-(raw[k] - want[k]), k))[: n - sum(want)]:
        want[k] += 1
    assert list(got) == want


def test_repair_gives_each_split_the_label(spark):
    d = spark.createDataFrame([(f"g{k}", "A|B" if k < 3 else "A", 1 + k, "train") for k in range(6)], "group_id string, labels string, n_rows long, split string")
    out = corpora.repair_label_coverage(d, ["A", "B", "C"], "1").collect()
    for label in "AB":
        assert {r.split for r in out if label in r.labels.split("|")} == {"train", "validation", "test"}


def test_review_and_index_violations(spark):
    rows = spark.createDataFrame([(1, "r1"), (2, "r1"), (3, "r1")], "id int, first_reviewer string")
    dec = spark.createDataFrame([(1, "approve", "r2"), (2, "approve", "r1"), (9, "approve", "r2")], "id int, decision string, reviewer string")
    ok, bad = corpora.apply_review_decisions(rows, dec, "id")
    assert [r.id for r in ok.collect()] == [1]
    assert {(r.id, r.code) for r in bad.collect()} == {(2, "SAME_REVIEWER"), (3, "UNDECIDED"), (9, "UNKNOWN_ID")}
    index = spark.createDataFrame([(1,), (2,), (2,), (8,)], "id int")
    good, bad = corpora.attach_index(rows, index, "id")
    assert [r.id for r in good.collect()] == [1]
    assert {(r.id, r.code) for r in bad.collect()} == {(2, "INDEX_REPEATED"), (3, "INDEX_MISSING"), (8, "SOURCE_MISSING")}


def test_sms_rows_and_counts(spark):
    sms = spark.createDataFrame([("MoMo", "hi", 1, 1700000000000), (" momo ", "hi", 1, 1700000000000), ("MoMo", "sent", 2, 1), ("x", "y", 1, 1), (None, None, None, None)], "address string, body string, type int, date long")
    rows, counts = corpora.normalize_sms(sms, {"MoMo": "MTN_MOMO"})
    assert [(r.body, r.copies) for r in rows.collect()] == [("hi", 2)]
    assert one(counts) == {"unknown_sender": 2, "not_incoming": 1, "kept": 2}


def test_manifest_rules(spark):
    schema = "sample_id string, group_id string, source_type string, label int, split string, contains_personal_data boolean, anonymisation_status string, permission string, relative_path string, private_object_id string, sha string, seed int, parent_sample_id string, tamper_metadata string, operations array<string>, notes string"
    good = ("a", "g", "controlled_tamper", 1, "train", False, "not_applicable", "c", "p", None, "0" * 64, 1, "b", '{"operations":[{"name":"crop"}]}', ["crop"], "")
    empty = (None,) * 16
    d = spark.createDataFrame([good, empty], schema)
    codes = {}
    for r in records.manifest_rules(d, F.lit(False)).collect():
        codes.setdefault(r.sample_id, set()).add(r.code)
    assert "a" not in codes
    assert codes[None] == {"missing_identity", "invalid_source_type", "invalid_label", "invalid_split", "invalid_anonymisation", "missing_permission", "invalid_location", "invalid_sha256"}


def test_feature_contract(spark):
    contract = records.feature_contract(spark, [("v", 0, 1, False), ("w", -1, 1, True), ("gone", 0, 1, True), ("flag", 0, 1, False)], {"c": ["A", "B"], "n": ["1"]})
    rows = [(1, 0.5, None, True, "A", 1), (2, None, 2.0, True, None, 1), (3, float("nan"), -2.0, None, "C", None), (4, 9.0, float("-inf"), False, "B", 1)]
    d = spark.createDataFrame(rows, "id int, v double, w double, flag boolean, c string, n int").withColumns({"label": F.lit(1), "more": F.lit(1)})
    got = {(r.id, r.feature, r.code) for r in records.check_feature_contract(d, "id", contract).collect()}
    assert got == {
        (None, "label", "FORBIDDEN_FEATURE"), (None, "more", "UNKNOWN_FEATURE"), (None, "gone", "MISSING_FEATURE"), (2, "v", "NULL_NOT_ALLOWED"), (3, "v", "NOT_FINITE"), (4, "v", "ABOVE_MAXIMUM"),
        (2, "w", "ABOVE_MAXIMUM"), (3, "w", "BELOW_MINIMUM"), (4, "w", "NOT_FINITE"), (1, "flag", "NOT_NUMERIC"), (2, "flag", "NOT_NUMERIC"), (3, "flag", "NULL_NOT_ALLOWED"), (4, "flag", "NOT_NUMERIC"),
        (2, "c", "NULL_NOT_ALLOWED"), (3, "c", "NOT_IN_CATEGORIES"), (3, "n", "NULL_NOT_ALLOWED"), *((k, "n", "NOT_IN_CATEGORIES") for k in (1, 2, 4)),
    }
    assert len(records.NUMERIC_FEATURES) + len(records.CATEGORICAL_FEATURES) == 46
    bare = records.check_feature_contract(spark.createDataFrame([(1,)], "id int"), "id").collect()
    assert len(bare) == 46 and {r.code for r in bare} == {"MISSING_FEATURE"}


def test_model_beats_dummy_and_calibrates(spark):
    d = spark.range(600).select((F.col("id") % 3 == 0).cast("int").alias("label"), (F.when(F.col("id") % 3 == 0, 2.0).otherwise(0.0) + (F.col("id") % 7) / 3).alias("x"))
    got = {r.candidate: r.average_precision for r in models.fit_candidates(d, d, ["x"], seeds=[42], trees=3, depth=3).collect()}
    assert set(got) == {"dummy", "logistic", "boosted", "forest"} and all(got[k] > got["dummy"] for k in got if k != "dummy")
    s = models.scored(models.fit(d, ["x"], "logistic"), d).select("label", "score")
    methods = models.calibrate(s, s).collect()
    assert {r.method for r in methods} == {"sigmoid", "isotonic"} and sum(r.chosen for r in methods) == 1


def test_cross_source_scores_without_fitting(spark):
    rising = spark.range(300).select((F.col("id") >= 150).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    falling = rising.select((1 - F.col("label")).alias("label"), "x")
    sources = {"up": rising, "also_up": rising, "down": falling}
    fitted = {k: models.fit(sources[k], ["x"], "logistic") for k in ("up", "down")}
    got = {(r.trained_on, r.scored_on): (r.n_rows, r.roc_auc) for r in models.cross_source(fitted, sources).collect()}
    assert got == {("up", "also_up"): (300, 1.0), ("up", "down"): (300, 0.0), ("down", "up"): (300, 0.0), ("down", "also_up"): (300, 0.0)}


def test_sensitive_tokens_equal_brute_force(spark):
    texts = ["see https://a.b/c?d=e@f.gh and mail x@y.zz, GHS 1,200.50 or GHS5", "call +233241234567 REF123456 no@mark", "0123456789 GHS", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in messages.tokenize_sensitive(d).collect():
        t = texts[r.k]
        for kind, pattern in messages.SENSITIVE:
            assert r[f"n_{kind.lower()}"] == (None if t is None else len(re.findall(pattern, t)))
            t = None if t is None else re.sub(pattern, f"[{kind}]", t)
        assert r.clean == t


def test_stream_verification_equals_batch(spark, tmp_path):
    ref = (1, "MTN_MOMO", "REF-000001", 10.0, "GHS", "AMA", "+233241111111", "SHOP", "+233501111111", datetime(2024, 1, 1), "SUCCESS")
    names = "provider_code string, transaction_reference string, amount double, currency string, sender_name string, sender_phone string, receiver_name string, receiver_phone string, occurred_at timestamp, transaction_status string"
    refs = spark.createDataFrame([ref], f"ref_id long, {names}")
    obs = spark.createDataFrame([(7, *ref[1:]), (8, "MTN_MOMO", "REF-000001", 11.0, *ref[4:]), (9, "MTN_MOMO", "OTHER", 1.0, *ref[4:])], f"observation_id long, {names}")
    obs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(obs.schema).parquet(f"{tmp_path}/in")
    streams.stream_verification(stream, refs, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = {r.observation_id: r.verification_status for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {7: "VERIFIED", 8: "MISMATCH", 9: "UNVERIFIED"}


def test_feature_columns(spark):
    d = spark.createDataFrame([(1, 2)], "a int, b int")
    assert records.assert_feature_columns(d, ["a", "b"], ["c"]) is d
    for expected, forbidden in ((["b", "a"], []), (["a", "b"], ["b"])):
        with pytest.raises(ValueError):
            records.assert_feature_columns(d, expected, forbidden)


def test_word_error_rate(spark):
    pairs = [("a b c d", "a x c"), ("Same  words", "same words"), ("", "two words"), ("w " * 400, "w " * 399 + "v"), (None, "a"), (" ".join(f"w{k}" for k in range(600)), " ".join(f"w{k}" for k in range(1, 600)))]
    d = spark.createDataFrame(pairs, "t string, r string").withColumn("e", messages.word_error_rate(F.col("t"), F.col("r")))
    assert [r.e for r in d.collect()] == [0.5, 0.0, 2.0, 0.0025, None, round(1 / 600, 6)]


def test_every_order_is_observed(spark):
    assert view(spark, SF, "obs").count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_field_confidence_reads_whole_turns(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id, r.turn] = min(r.text, turns.get((r.conv_id, r.turn), r.text))
    assert max(map(len, turns.values())) > 20
    clean = lambda w: re.sub("[^A-Z0-9]", "", w.upper())
    tokens = {}
    for t in view(spark, SF, "tokens").collect():
        tokens.setdefault((t.doc, clean(t.text)), []).append(t.confidence)
    got = {(r.doc, r.field): r.confidence for r in catalog.QUERIES["x15_field_confidence"](spark, SF).collect()}
    for (doc, turn), text in turns.items():
        found = [c for w in {clean(w) for w in text.split(" ")} - {""} for c in tokens.get((doc, w), [])]
        want = min(1.0, (sum(found) / len(found) / 100 if found else 0.45) + (0.1 if turn % 2 == 0 else 0))
        assert got[doc, f"f{turn}"] == pytest.approx(want, abs=1e-4)
    assert len(got) == len(turns)


def test_message_patterns_equal_brute_force(spark):
    texts = [
        "see www.shop.gh/x or HTTP://A.B", "call 024 123 4567 or +233-50-1234567", "ghs 20, GHC 5.50, GH₵ 7, gh¢8", "ref ab-12-cd-345 abcdefg1 abcdefgh", "Ama sent 20 GHS at 10:20 on 2024-01-02 from 10.0.0.1",
        "you bought airtime", "cash in", "a reversal", "transfer of goods", "your code is\n 4711", "1234 is the OTP", "otp", "hotpot 4711", "Sender: Ama Mensah", "name: demo user", "Reference: AB12-3456", "reference=DEMO-12345", "tel 0241234567", "x [URL_1[", "", None,
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    held = lambda p, t: t is not None and re.search(p, t) is not None
    counts = {}
    for r in messages.tokenize_sensitive(d).collect():
        t = texts[r.k]
        for kind, pattern in messages.SENSITIVE if t is not None else []:
            t, n = re.subn(pattern, f"[{kind}]", t)
            assert r[f"n_{kind.lower()}"] == n
            counts[kind] = counts.get(kind, 0) + n
        assert r.clean == t
    assert counts == {"URL": 2, "EMAIL": 0, "PHONE": 3, "MONEY": 4, "REFERENCE": 5}
    every = [*(p for k, p in messages.SENSITIVE if k not in ("URL", "REFERENCE")), *messages.RESIDUAL, messages.SECRET]
    assert {r.k for r in messages.residual_gate(d, "text").collect()} == {k for k, t in enumerate(texts) if any(held(p, t) for p in every)}
    assert {r.k for r in messages.secret_quarantine(d)[1].collect()} == {9, 10}
    category = {r.k: r.c for r in d.select("k", messages.message_category(F.col("text")).alias("c")).collect()}
    assert {k for k, c in category.items() if c == "transaction_confirmation"} == {5, 6, 7} and len(messages.CUES) == 17
    found = {r.k: r.c for r in d.select("k", messages.identifier_categories(F.col("text")).alias("c")).collect()}
    assert {k: c for k, c in found.items() if c} == {13: "personal_name", 15: "transaction_reference", 17: "phone_number"}


def test_every_source_is_fitted_and_scored(spark):
    sources = {r[0] for r in view(spark, SF, "tx").select("transaction_type").distinct().collect()}
    got = {(r.trained_on, r.scored_on) for r in catalog.QUERIES["e13_cross_source"](spark, SF).select("trained_on", "scored_on").collect()}
    assert len(sources) == 5 and got == {(a, b) for a in sources for b in sources if a != b}


def test_candidates_run_on_every_seed(monkeypatch):
    from sparkledger.plans import models as plans

    given = {}
    monkeypatch.setattr(plans, "_rows", lambda tx: tx)
    monkeypatch.setattr(models, "fit_candidates", lambda *args, **named: given.update(named, n=len(args)))

    class Rows:
        def where(self, _):
            return self

    plans.e11_e14_candidates(Rows())
    assert given == {"n": 3, "categorical": ["transaction_type"]} and models.SEEDS == [42, 123, 2026]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_of_whole_turns(spark):
    turns = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): (r.cer, r.wer) for r in catalog.QUERIES["x11_error_rates"](spark, SF).collect()}
    fold = lambda t: re.sub(r"[ \t\n\r]+", " ", t.lower()).strip(" ")
    want = {k: (fold(t), fold(turns[k[0], k[1] + 1])) for k, t in turns.items() if (k[0], k[1] + 1) in turns}
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        x, y = a.split(" "), b.split(" ")
        assert got[k] == (pytest.approx(edits(a, b) / max(len(a), 1), abs=1e-6), pytest.approx(edits(x, y) / max(len(x), 1), abs=1e-6))


def test_model_queries_read_stored_rows(spark, monkeypatch):
    """No fit, score or metric works out the causal windows again."""
    from sparkledger.plans import models as plans

    seen = []
    monkeypatch.setattr(models, "fit", lambda train, *_, **__: seen.append(train))
    monkeypatch.setattr(models, "scored", lambda model, d: d.withColumn("score", F.lit(0.5)))
    monkeypatch.setattr(models, "calibrate", lambda a, b: seen.extend([a, b]))
    monkeypatch.setattr(models, "cross_source", lambda m, tunes: seen.extend(tunes.values()))
    monkeypatch.setattr(models, "fit_candidates", lambda train, tune, *_, **__: seen.extend([train, tune]))
    tx = view(spark, SF, "tx")
    plans.e12_calibrate(tx)
    plans.e13_cross_source(tx)
    plans.e11_e14_candidates(tx)
    assert len(seen) > 10
    for d in seen:
        assert "Window" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_class_weights_are_stored(spark):
    """A pass of a fit reads the weights instead of counting the classes again."""
    train = spark.range(40).select((F.col("id") % 4 == 0).cast("int").alias("label"))
    d = models.weighted(train)
    assert "Aggregate" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in d.collect()} == {(1, 2.0), (0, 40 / 60)}


def test_calibration_works_its_rows_out_once(spark, monkeypatch):
    """Neither side is scored again for each method, and a frequent score is one row of each label to the isotonic fit."""
    seen = {"first": spark.sparkContext.accumulator(0), "second": spark.sparkContext.accumulator(0)}

    def rows(side):
        def score(k):
            seen[side].add(1)
            return k % 5 / 5

        return spark.range(2000).select(((F.col("id") * 7) % 10 < F.col("id") % 5 * 2).cast("int").alias("label"), F.udf(score, "double")("id").alias("score"))

    fitted = []

    class Isotonic(models.IsotonicRegression):
        def fit(self, d):
            fitted.append(d.count())
            return super().fit(d)

    monkeypatch.setattr(models, "IsotonicRegression", Isotonic)
    got = models.calibrate(rows("first"), rows("second")).collect()
    assert {r.method for r in got} == {"sigmoid", "isotonic"}
    assert {k: a.value for k, a in seen.items()} == {"first": 2000, "second": 2000}
    rates = {s: [((k * 7) % 10 < s * 2) for k in range(2000) if k % 5 == s] for s in range(5)}
    assert fitted[0] == sum(len(set(r)) for r in rates.values()) <= 10
    best = {s: sum(r) / len(r) for s, r in rates.items()}
    assert sorted(best.values()) == list(best.values())  # so that the isotonic fit is the rate of each score
    want = sum((best[s] - y) ** 2 for s, r in rates.items() for y in r) / 2000
    assert next(r.brier for r in got if r.method == "isotonic") == pytest.approx(want, abs=1e-8)


def test_residual_gate_reads_whole_messages(spark):
    """Every message of the view has an amount before its document's text."""
    n = view(spark, SF, "msgs").count()
    held = {r[0] for r in catalog.QUERIES["m4_residual_gate"](spark, SF).select("record_id").collect()}
    documents = {r[0] for r in catalog.QUERIES["m4_document_gate"](spark, SF).select("doc_id").collect()}
    assert len(held) == n and "FROM msgs" in catalog.SQL["m4_residual_gate"] and documents < held


@pytest.mark.parametrize("name", ["x11_error_rates", "x11_text_error_rate"])
def test_error_rates_are_dealt_by_work(spark, monkeypatch, name):
    """A few megabytes of turns are much work, so the size of the tables does not settle the number of tasks."""
    few = catalog.QUERIES[name](spark, SF)
    monkeypatch.setattr(messages, "TASK_WORK", 1 << 20)
    many = catalog.QUERIES[name](spark, SF)
    assert many.rdd.getNumPartitions() >= 4 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
