"""Periodic runs against a brute-force search, and the registered query against plain Python on sf0.001."""

import hashlib
import random
import zlib
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkledger.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(w):
    """Every (start, length, period) by trying each period at each place."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(w[s : e - d] == w[s + d : e] for d in range(1, q)):
                found.add((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, alphabet):
    out = []
    for _ in range(rng.randint(1, 5)):
        out += [str(rng.randrange(alphabet)) for _ in range(rng.randint(0, 40))]
        unit = [str(rng.randrange(alphabet)) for _ in range(rng.randint(1, 60))]
        out += [unit[i % len(unit)] for i in range(rng.randint(3 * len(unit), 6 * len(unit)))]
    return " ".join(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [60, 1 << 19])
def test_runs_of_made_texts(seed, chunk, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", chunk)
    rng = random.Random(seed)
    texts = [periodic(rng, a) for a in (1, 2, 3, 40) for _ in range(6)]
    texts += texts[:3] + ["", None, "a", "a a a a a", "a a a a a a"]
    for t, (runs, collapsed) in zip(texts, periodic_runs.collapse(texts), strict=True):
        w = words_of(t or "")
        want = brute(w)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert collapsed == kept(w, want)


def test_misleading_hashes_fall_back_to_lag_scans(monkeypatch):
    """With a hash of two values every seed is suspect; what is found is compared word by word."""
    monkeypatch.setattr(periodic_runs, "_mixed", lambda a, b: (a ^ b) & 1)
    w = [str(k % 20) for k in range(100)] + [str(100 + k) for k in range(30)]
    for r in next(periodic_runs.collapse([" ".join(w)]))[0]:
        assert (r["start"], r["length"], r["period"]) in brute(w)


def test_awkward_rows(spark):
    long = " ".join(f"w{k % 3001}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "\t x \x0b"), (4, "a b " * 5), (4, "a b " * 5), (None, "a " * 9), (5, long), (6, "é ß " * 4)]
    docs = spark.createDataFrame([(k, t, "r", "f", "c") for k, t in rows], "doc_id long, text string, runs string, found string, collapsed string")
    out = periodic_runs.collapse_runs(docs)
    assert out.columns == [*docs.columns, "runs_", "collapsed_"]
    got = sorted((r["doc_id"] or 0, r["collapsed_"], [tuple(x) for x in r["runs_"]]) for r in out.collect())
    assert got[:3] == [(0, "a", [(0, 9, 1)]), (1, "", []), (2, "", [])]
    assert got[3:6] == [(3, "x", []), (4, "a b", [(0, 10, 2)]), (4, "a b", [(0, 10, 2)])]
    assert got[6] == (5, " ".join(f"w{k}" for k in range(3001)), [(0, 60_000, 3001)]) and got[7][1] == "é ß"
    assert periodic_runs.collapse_runs(docs.where(F.lit(False))).count() == 0


def test_planted_texts_without_words(spark):
    chosen = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 10 == 0][:6]
    texts = [None, "", " \n", "one", "one two", "a b c d e f g h"]
    docs = spark.createDataFrame([*zip(chosen, texts, strict=True), (None, "x x")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in queries.planted_runs(docs).collect()}
    assert [got[k] for k in chosen[:4]] == texts[:4] and got[None] == "x x"
    for k, t in zip(chosen[4:], texts[4:], strict=True):
        w, g = t.split(), zlib.crc32(str(k).encode()) // 10
        a = g % len(w)
        assert got[k] == " ".join(w[:a] + [w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8))] for i in range(a, len(w))])


def test_op11(spark):
    out = entry.queries()["op11_periodic_runs"](spark, SF)
    got = {r["doc_id"]: r for r in out.collect()}
    texts = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    planted = 0
    for k, t in texts.itertuples(index=False):
        w = words_of(t or "")
        h, n = zlib.crc32(str(k).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = brute(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        r = got[k]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, milli)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and r["collapsed_sha256"] == sha(kept(w, runs))
    assert planted > 5 and len(got) == len(texts)
    assert [t for c, t in out.dtypes if c not in ("runs_sha256", "collapsed_sha256")] == ["bigint"] * 6
