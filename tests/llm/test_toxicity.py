"""The toxicity classifier from end to end against an exact solution of the same problem in plain Python, and awkward rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkledger.llm import toxicity

SF = "/root/testdata/sf0.001"


def grams(text):
    """The 3- to 5-grams inside the words of a text, with the gap before and after a word as a blank."""
    t = " " + "".join(" " if c < "\x80" and not c.isalnum() else c for c in (text or "").lower()) + " "
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1) if " " not in t[i + 1 : i + n - 1]}


def solved(rows, toxic):
    """Weights and intercept of least square norm plus LOSS times the log loss, by Newton's method over the rows."""
    p, n = sum(toxic), len(toxic) - sum(toxic)
    counts = [Counter(g for r, y in zip(rows, toxic, strict=True) if y == k for g in r) for k in (1, 0)]
    a, scale = 2 * p / (p + n), {}
    for g in counts[0].keys() | counts[1].keys():
        x, y = counts[0][g], counts[1][g]
        ratio = math.log((x + a) / (p + 2)) - math.log((y + 2 - a) / (n + 2))
        error = 1 / (x + a) + 1 / (y + 2 - a)
        scale[g] = ratio * (ratio**2 / (ratio**2 + toxicity.SHRINK**2 * error)) ** 2
    kernel = np.array([[sum(scale[g] ** 2 for g in r & s) + 1 for s in rows] for r in rows])
    sign, held = np.where(np.array(toxic) > 0, 1.0, -1.0), np.zeros(len(rows))
    for _ in range(200):  # f = kernel @ held; held = LOSS * sign * sigmoid(-sign * f) at the optimum
        f = kernel @ held
        s = 1 / (1 + np.exp(np.clip(sign * f, -500, 500)))
        gap = held - toxicity.LOSS * sign * s
        slope = np.eye(len(rows)) + toxicity.LOSS * (s * (1 - s))[:, None] * kernel
        step = np.linalg.solve(slope, gap)
        while True:  # halve a step that leads uphill
            new = held - step
            g = kernel @ new
            if np.abs(new - toxicity.LOSS * sign / (1 + np.exp(np.clip(sign * g, -500, 500)))).max() <= max(np.abs(gap).max(), 1e-12) or np.abs(step).max() < 1e-12:
                break
            step = step / 2
        held = new
        if np.abs(step).max() < 1e-10:
            break
    weights = Counter()
    for r, h in zip(rows, held, strict=True):
        for g in r:
            weights[g] += h * scale[g] ** 2
    return weights, float(held.sum())


def test_query_equals_the_exact_solution(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet").dropna(subset=["toxic"])
    texts = dict(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    train = [(k, int(y)) for k, y in zip(labels.doc_id.tolist(), labels.toxic.tolist(), strict=True) if fold(k) != 2 and k in texts]
    weights, b = solved([grams(texts[k]) for k, _ in train], [y for _, y in train])
    got = {r["doc_id"]: r for r in entry.queries()["op2_toxicity"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        score = 1 / (1 + math.exp(-(b + sum(weights[g] for g in grams(t)))))
        assert got[k]["score"] == pytest.approx(score, abs=0.03)  # eight passes come near the optimum
        assert got[k]["held_out"] == (fold(k) == 2) and got[k]["predicted"] == int(got[k]["score"] >= 0.3)


def test_awkward_rows(spark):
    bad, good = "you are a vile horrid fool and a liar", "the weather over the hills is mild today"
    rows = [(k, f"{bad if k % 2 else good} number {k}") for k in range(40)] + [(None, bad), (100, None), (101, ""), (102, f"{good} " * 30_000), (3, f"{bad} number 3")]
    docs = spark.createDataFrame([(k, t, "w", 0.5, 7) for k, t in rows], "doc_id long, text string, weights string, score double, toxic int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 1), (None, 1), (200, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(by[3]) == 2 and by[3][0] == by[3][1]  # repeated rows score alike
    assert by[100] == by[101] and by[None][0] > 0.5 > by[102][0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}
