"""Causal windows, splits, sources and streams on small literal rows, and every catalog query against DuckDB."""

import json
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkledger.operators import causal, evaluation, references, transactions
from sparkledger.plans import catalog
from sparkledger.sources import tables
from sparkledger.streaming import streams

SF = "/root/testdata/sf0.001"
TX = "row_no long, step int, transaction_type string, amount double, initiator_id string, recipient_id string, label_is_fraud int"


@pytest.fixture(scope="module")
def tx(spark):
    rows = [(1, 1, "PAY", 10.0, "C1", "M1", 0), (2, 2, "SEND", 30.0, "C1", "M2", 0), (3, 8, "PAY", 40.0, "C1", "M1", 1), (4, 26, "PAY", 50.0, "C1", "M3", 0), (5, 26, "SEND", 5.0, "C1", "M3", 0), (6, 3, "PAY", 1.0, "C2", "C1", 0)]
    return spark.createDataFrame(rows, TX)


def test_causal_windows(tx):
    r = {x["row_no"]: x for x in causal.causal_features(tx).collect()}
    x = r[4]
    assert (x["prior_24h_count"], x["prior_24h_amount"], x["prior_mean"], x["prior_median"]) == (2, 70.0, 35.0, 35.0)
    assert x["sequence_pattern"] == "PAY->PAY" and r[1]["sequence_pattern"] == "START->PAY"
    assert x["steps_since_previous"] == 18 and r[1]["steps_since_previous"] is None and r[1]["prior_mean"] is None
    assert r[5]["prior_24h_count"] == 2 and r[5]["is_new_recipient"] == 1 and r[3]["is_new_recipient"] == 0
    assert x["graph_degree"] == 3 and x["unique_recipients"] == 2


def test_split_reaches_positives(spark):
    stats = spark.createDataFrame([(s, int(s in (2, 5, 11))) for s in range(20)], "step int, positives long")
    assert [p[1:] for p in transactions.plan_time_split(stats)] == [(0, 13), (14, 15), (16, 17), (18, 19)]
    tuned = transactions.plan_time_split(stats, 1)
    assert all(any(a <= s <= b for s in (2, 5, 11)) for _, a, b in tuned[1:])


def test_policy_order(spark):
    """Each rule in its place, with the reasons, missing signals, limitations and status that go with it."""
    made = lambda *codes: [(c, f"{c} {k}", "LOW") for k, c in enumerate(codes)]
    base = dict(mm=None, sa=True, sc="GENUINE", sr=["S_OFF"], ia=True, ic="genuine", im=0.1, ir=["I_OFF", "S_OFF"], fc=True, vs="UNVERIFIED", sem=None, img=None, cf=None)
    cases = {
        "mismatch": (dict(mm=["transaction_reference", "amount"], sc="FRAUDULENT"), "high_risk", "COMPLETED", ["REFERENCE_AMOUNT_MISMATCH", "REFERENCE_TRANSACTION_REFERENCE_MISMATCH"], []),
        "fraud": (dict(sc="FRAUDULENT", ia=False), "high_risk", "PARTIAL", ["STRUCTURED_MODEL_HIGH_RISK"], ["I_OFF", "S_OFF"]),
        "tampered": (dict(ic="tampered", im=0.85, sc="SUSPICIOUS"), "high_risk", "COMPLETED", ["IMAGE_MODEL_TAMPER_THRESHOLD_EXCEEDED"], []),
        "not tampered": (dict(ic="tampered", im=0.84, sc="SUSPICIOUS"), "medium_risk", "COMPLETED", ["STRUCTURED_MODEL_MEDIUM_RISK"], []),
        "image off": (dict(ic="tampered", im=0.99, ia=False), "low_risk", "PARTIAL", ["STRUCTURED_MODEL_LOW_RISK"], ["I_OFF", "S_OFF"]),
        "other class": (dict(ic="genuine", im=0.99), "low_risk", "COMPLETED", ["STRUCTURED_MODEL_LOW_RISK"], []),
        "incomplete": (dict(fc=False), "inconclusive", "PARTIAL", ["INSUFFICIENT_EVIDENCE"], ["CRITICAL_OCR_FIELDS_INCOMPLETE", "REFERENCE_RECORD_UNAVAILABLE"]),
        "incomplete, medium": (dict(fc=False, sc="SUSPICIOUS"), "medium_risk", "COMPLETED", ["STRUCTURED_MODEL_MEDIUM_RISK"], []),
        "nothing": (dict(sa=False, ia=False, vs="VERIFIED"), "inconclusive", "PARTIAL", ["INSUFFICIENT_EVIDENCE"], ["CONCLUSIVE_MODEL_EVIDENCE_UNAVAILABLE", "I_OFF", "S_OFF"]),
        "class of a model that is off": (dict(sa=False, sc="FRAUDULENT"), "inconclusive", "PARTIAL", ["INSUFFICIENT_EVIDENCE"], ["CONCLUSIVE_MODEL_EVIDENCE_UNAVAILABLE", "REFERENCE_RECORD_UNAVAILABLE", "S_OFF"]),
        "repeated reasons": (dict(sem=made("A", "B"), img=made("C", "A")), "low_risk", "COMPLETED", ["STRUCTURED_MODEL_LOW_RISK", "B", "C", "A"], []),
        "unknown field": (dict(mm=["amount", "sender"]), None, "INPUT_INVALID", [], []),
    }
    names = ["critical_mismatches", "structured_available", "structured_class", "structured_reasons", "image_available", "image_class", "image_score", "image_reasons", "fields_complete", "verification_status", "semantic_reasons", "image_signals", "corrected_fields"]
    words, reasons = "array<string>", evaluation.REASONS
    kinds = [words, "boolean", "string", words, "boolean", "string", "double", words, "boolean", "string", reasons, reasons, words]
    rows = [(k, *(base | change).values()) for k, (change, *_) in cases.items()] + [("nulls", *[None] * 13)]
    e = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))
    got = {r["id"]: r for r in evaluation.risk_policy(e).collect()}
    for k, (_, band, status, codes, missing) in cases.items():
        r = got[k]
        assert (r["band"], r["status"], [x["code"] for x in r["reasons"]], r["missing_signals"], r["score"]) == (band, status, codes, missing, None), k
    assert got["repeated reasons"]["reasons"][3]["title"] == "A 0" and got["repeated reasons"]["limitations"] == ["DETERMINISTIC_IMAGE_SUPPORTING_ONLY"]
    assert got["nothing"]["limitations"] == ["STORED_REFERENCE_MATCH_NOT_AUTHENTICITY"] and got["fraud"]["risk_class"] == "HIGH"
    assert got["nulls"]["band"] == "inconclusive" and got["nulls"]["missing_signals"] == ["CONCLUSIVE_MODEL_EVIDENCE_UNAVAILABLE", "CRITICAL_OCR_FIELDS_INCOMPLETE"]



def test_near_duplicates_by_bits(spark):
    rows = [(1, 7, 0), (2, 7, 63), (3, 7, 127), (4, 7, 0)]
    got = {tuple(r) for r in references.near_duplicates(spark.createDataFrame(rows, "id long, hi long, lo long"), 6).collect()}
    assert got == {(1, 2, 6), (2, 3, 1)}


def test_sources(spark, tx, tmp_path):
    (tmp_path / "a.csv").write_text("step,type\n1,PAY\n2,SEND\n")
    assert [tuple(r) for r in tables.read_transactions(spark, str(tmp_path / "a.csv"), ["step", "type"]).select("step", "type", "row_no").orderBy("row_no").collect()] == [("1", "PAY", 1), ("2", "SEND", 2)]
    (tmp_path / "big").mkdir()
    for name in ("x", "y"):
        (tmp_path / f"big/{name}.csv").write_text("step,type\n" + "".join(f"{k},T{k:09d}\n" for k in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    numbered = tables.read_transactions(spark, str(tmp_path / "big"), ["step", "type"])
    assert numbered.rdd.getNumPartitions() > 4 and numbered.where("CAST(step AS INT) <> row_no").count() == 0 and numbered.count() == 8000
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        tables.read_transactions(spark, str(tmp_path / "a.csv"), ["type", "step"])
    (tmp_path / "r.csv").write_text("provider_code,amount\nA,1\nB,2,3\n")
    r = tables.read_reference_csv(spark, str(tmp_path / "r.csv"), ["amount"], ["provider_code", "amount"])
    assert sorted((x["provider_code"], x["malformed"]) for x in r.collect()) == [("A", False), ("B", True)]
    (tmp_path / "m.xml").write_text('<smses count="2"><sms address="A" body="x" type="1" date="1000"/><sms address="B" body="y" type="1" date="2000"/></smses>')
    assert tables.read_sms_backup(spark, str(tmp_path / "m.xml")).count() == 2
    entry = {"participant_id_hash": "a" * 64, "withdrawn_at": "2024-01-02T10:20:30Z", "scope": "future_processing_only", "status": "completed", "request_reference": "R1"}
    ledger = lambda *entries, version="withdrawal-ledger-v1": (tmp_path / "w.json").write_text(json.dumps({"schema_version": version, "entries": list(entries)}))
    ledger(entry, entry | {"participant_id_hash": "b" * 64, "withdrawn_at": "2024-01-02T10:20:30+02:00"})
    assert {tuple(r)[:3:2] for r in tables.read_withdrawal_ledger(spark, str(tmp_path / "w.json")).collect()} == {("a" * 64, "future_processing_only"), ("b" * 64, "future_processing_only")}
    odd = [{"participant_id_hash": "A" * 64}, {"withdrawn_at": "yesterday"}, {"withdrawn_at": "2024-13-02T10:20:30Z"}, {"scope": "all"}, {"status": "active"}, {"request_reference": " "}, {"more": "x"}]
    for change in [entry | x for x in odd] + [{k: v for k, v in entry.items() if k != "status"}, entry]:
        ledger(entry, change if change is entry else change | {"participant_id_hash": change["participant_id_hash"].replace("a", "c")})
        with pytest.raises(ValueError, match="break a rule"):
            tables.read_withdrawal_ledger(spark, str(tmp_path / "w.json"))
    ledger(entry, version="1")
    with pytest.raises(ValueError, match="withdrawal-ledger-v1"):
        tables.read_withdrawal_ledger(spark, str(tmp_path / "w.json"))
    parted = tx.withColumn("partition", F.when(F.col("step") < 20, "train").otherwise("test")).withColumn("source_row_id", F.col("row_no").cast("string"))
    tables.write_feature_dataset(parted, str(tmp_path / "d"), ["amount", "step"], "label_is_fraud", ["dataset"] if "dataset" in parted.columns else ["row_no"])
    assert tables.load_partition(spark, str(tmp_path / "d"), "train", ["source_row_id", "amount", "step"]).count() == 4
    with pytest.raises(PermissionError):
        tables.load_partition(spark, str(tmp_path / "d"), "test")
    a, b = (tables.content_fingerprint(x, ["row_no"]).first() for x in (tx, tx.orderBy(F.desc("row_no"))))
    assert a == b != tables.content_fingerprint(tx.limit(3), ["row_no"]).first()


def test_stream_equals_batch(spark, tx, tmp_path):
    rows = tx.withColumn("event_time", F.timestamp_seconds(F.col("step") * 3600)).orderBy("step").collect()
    last = (99, 216, "PAY", 0.0, "C9", "M9", 0, None)
    schema = f"{TX}, event_time timestamp"
    import datetime

    rows = [tuple(r) for r in rows] + [(*last[:7], datetime.datetime(1970, 1, 10, tzinfo=datetime.timezone.utc))]
    for k, part in enumerate((rows[:3], rows[3:6], rows[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_causal_features(stream, 0).writeStream.format("memory").queryName("causal").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    names = [c for c in streams._NAMES if c != "initiator_id"]
    want = {r["row_no"]: tuple(r[c] for c in names) for r in causal.causal_features(tx).collect()}
    assert {r["row_no"]: tuple(r[c] for c in names) for r in spark.table("causal").collect()} == want


def test_stream_with_a_hot_actor_equals_batch(spark, tmp_path):
    import random

    random.seed(4)
    rows = [(k, random.randrange(1, 60), random.choice(["PAY", "SEND"]), float(random.randrange(50)), random.choice(["C1", "C1", "C2"]), random.choice(["M1", "C1", "M2", "M3"]), 0) for k in range(400)]
    tx = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), TX).withColumn("event_time", F.timestamp_seconds(F.col("step") * 3600))
    end = spark.createDataFrame([(999, 500, "PAY", 0.0, "C9", "M9", 0)], TX).withColumn("event_time", F.timestamp_seconds(F.col("step") * 3600))
    for part in (tx.where("step < 20"), tx.where("step >= 20"), end):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_causal_features(stream, 0).writeStream.format("memory").queryName("hot").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[-1] < 20 < max(held) < 400  # 400 rows are sent, and as many received; steps are forgotten once they are passed
    names = [c for c in streams._NAMES if c != "initiator_id"]
    show = lambda v: round(v, 9) if isinstance(v, float) else v
    got = {r["row_no"]: tuple(show(r[c]) for c in names) for r in spark.table("hot").collect()}
    want = {r["row_no"]: tuple(show(r[c]) for c in names) for r in causal.causal_features(tx).collect()}
    assert got.keys() == want.keys()
    assert [(k, n, a, b) for k in got for n, a, b in zip(names, got[k], want[k], strict=True) if a != b] == []


def test_streamed_statistics_deduplication_and_late_rows(spark, tx, tmp_path):
    rows = tx.withColumn("event_time", F.timestamp_seconds(F.col("step") * 3600))
    end = rows.where("row_no = 1").withColumns({"step": F.lit(900), "event_time": F.timestamp_seconds(F.lit(900 * 3600)), "row_no": F.lit(99).cast("long")})
    for k, part in enumerate((rows.where("step < 20"), rows.where("step >= 20 OR step = 2"), end)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/k=*"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    once = run(streams.stream_dedup(stream(), ["row_no"], "2000 hours"), "once")
    assert sorted(r["row_no"] for r in once) == [1, 2, 3, 4, 5, 6, 99]
    stats = {r["start"].timestamp() // 3600: (r["n_rows"], r["positives"]) for r in run(streams.stream_step_stats(stream(), "30 hours"), "stats")}
    assert stats == {1: (1, 0), 2: (2, 0), 3: (1, 0), 8: (1, 1), 26: (2, 0)}
    fast = {(r["initiator_id"], r["start"].timestamp() // 3600): (r["n_rows"], r["amount"]) for r in run(streams.stream_velocity(stream(), "30 hours"), "fast")}
    assert fast["C1", 3] == (3, 95.0) and fast["C1", -22] == (1, 10.0) and fast["C2", 3] == (1, 1.0)
    streams.stream_late_aside(stream(), str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / "lc")).awaitTermination()
    ok, late = ([r["row_no"] for r in spark.read.schema(rows.schema).parquet(str(tmp_path / x)).collect()] for x in ("ok", "late"))
    assert late == [2] and sorted(ok) == [1, 2, 3, 4, 5, 6, 99]


def test_late_rows_of_batches_run_again(spark, tmp_path):
    """A batch reads nothing but the step before it, and gives the same when it is run again."""
    act = streams.late_aside(*(str(tmp_path / x) for x in ("ok", "late", "progress")))
    batches = [spark.createDataFrame([(s,) for s in steps], "step int") for steps in ([3, 5, 4], [4, 6, 5], [], [5, 6, 9], [8, 9])]
    for k in (0, 1, 1, 2, 2, 3, 3, 4):
        act(batches[k], k)
        if k == 3:
            shutil.rmtree(tmp_path / "ok/batch=0", ignore_errors=True)
    rows = lambda x, k: sorted(r["step"] for r in spark.read.schema("step int").parquet(str(tmp_path / f"{x}/batch={k}")).collect())
    assert [rows("ok", k) for k in (1, 2, 3, 4)] == [[5, 6], [], [6, 9], [9]] and [rows("late", k) for k in range(5)] == [[], [4], [], [5], [8]]
    assert sorted(x.name for x in (tmp_path / "progress").iterdir()) == ["batch=3", "batch=4"]


def test_publish_writes_once(spark, tx, tmp_path):
    at = str(tmp_path / "p")
    tables.publish(tx, at)
    with pytest.raises(FileExistsError):
        tables.publish(tx, at)
    assert tables.read_published(spark, at).count() == tx.count()


def test_a_writer_that_dies_is_invisible(spark, tx, tmp_path, monkeypatch):
    root, parted = str(tmp_path / "g"), tx.withColumns({"partition": F.lit("train"), "source_row_id": F.col("row_no").cast("string")})
    write = lambda: tables.write_feature_dataset(parted, root, ["amount"], "label_is_fraud", ["row_no"])
    compared = []

    def dies(*x):
        compared.append(x)
        if len(compared) == 3:
            raise RuntimeError("died between the writes")
        return fingerprint(*x)

    fingerprint = tables.content_fingerprint
    monkeypatch.setattr(tables, "content_fingerprint", dies)
    with pytest.raises(RuntimeError):
        write()
    with pytest.raises(FileNotFoundError):
        tables.load_partition(spark, root, "train")
    monkeypatch.setattr(tables, "content_fingerprint", lambda *x: spark.createDataFrame([(len(compared), len(compared))], "a int, b int") if compared.append(x) is None else None)
    with pytest.raises(ValueError, match="not written"):
        write()
    monkeypatch.setattr(tables, "content_fingerprint", fingerprint)
    write()
    assert all(tables.load_partition(spark, root, "train", dataset=d).count() == tx.count() for d in ("features", "labels", "provenance"))
    with pytest.raises(FileExistsError):
        write()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "customer", "supplier", "events", "documents", "labels", "embeddings", "pages", "conversations", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    """A value as text, alike from both engines."""
    return "~" if v is None or v != v else str(v) if not isinstance(v, float) else repr(v + 0.0)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    r = duck.execute(catalog.SQL[name])
    cols, theirs = sorted(df.columns), [x[0] for x in r.description]
    assert cols == sorted(theirs)
    want = sorted(tuple(shown(x[theirs.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(shown(x[c]) for c in cols) for x in df.collect()) == want
