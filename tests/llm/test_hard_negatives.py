"""Hard negatives: the threshold join against plain products, mining against brute force, and the query against its SQL."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from sparkledger.llm import hard_negatives
from sparkledger.llm import queries as llm

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, label int, embedding array<float>, uid string, v string, k int"


@pytest.mark.parametrize("width", [1, 7, 8, 19, 64])
@pytest.mark.parametrize("scale", [3, 300, 1 << 26])
def test_threshold_join_loses_no_pair(width, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELLS", 900)
    rng = np.random.default_rng(width)
    q, x = (np.floor(rng.normal(size=(n, width)) * scale).astype(np.int64) for n in (40, 170))
    q[3] = x[5] = 0
    scores = q @ x.T
    for share in (0.9, 0.5, 0.2, 0, -1):
        low = (share * np.abs(scores).max(1)).astype(np.int64)
        parts = list(hard_negatives.threshold_join(q, x, low))
        got = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts, strict=True)), strict=True))
        a, r = np.nonzero(scores >= low[:, None])
        assert got == sorted(zip(a.tolist(), r.tolist(), scores[a, r].tolist(), strict=True))


def test_scores_beyond_a_long_raise():
    far = np.full((1, 2), 1 << 40)
    with pytest.raises(OverflowError):
        list(hard_negatives.threshold_join(far, far, np.zeros(1, np.int64)))


def brute(rows, every, positives, negatives):
    fit = [(i, n, lab, [math.floor(256 * float(np.float32(c))) for c in v]) for n, (i, lab, v) in enumerate(rows) if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    first = lambda found: sorted(found, key=lambda r: (-r[0], math.inf if r[1] is None else r[1], r[2]))
    out = []
    for i, n, lab, v in fit:
        if i is None or i % every:
            continue
        for ps, pid, _ in first((dot(v, w), j, m) for j, m, other, w in fit if other == lab and m != n)[:positives]:
            inside = ((dot(v, w), j, m) for j, m, other, w in fit if other != lab and 30 * ps <= 100 * dot(v, w) <= 90 * ps)
            out += [(i, pid, k, j, ps, ns) for k, (ns, j, _) in enumerate(first(inside)[:negatives], 1)]
    return out


def key(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_mining(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 20)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)
    rng = np.random.default_rng(seed)
    rows = [(k, int(rng.integers(0, 3)), [float(c) for c in rng.integers(-2, 4, 12) / 8]) for k in range(90)]
    rows += [(200 + k, 1, rows[4][2]) for k in range(40)]  # a vector of a third of all rows, of one label
    rows += [rows[10], rows[0], (None, 2, rows[10][2]), (None, 0, rows[11][2])]
    rows += [(300, None, rows[0][2]), (301, 1, None), (305, 1, [0.5, None]), (310, 1, [math.nan]), (315, 1, [math.inf, 1.0]), (320, 0, []), (325, 2, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, "u", "v", 3) for r in rows], KIND).repartition(3)
    got = hard_negatives.mine(hard_negatives.prepare(df), hard_negatives.F.col("id") % 5 == 0, positives=3, negatives=4)
    assert key(got.collect()) == key(brute(rows, 5, 3, 4))


def test_tables_without_a_result(spark):
    mined = lambda rows: hard_negatives.mine(hard_negatives.prepare(spark.createDataFrame(rows, KIND)), hard_negatives.F.col("id") % 5 == 0).collect()
    assert mined([]) == []
    assert mined([(0, 1, [1.0], "", "", 0)]) == []  # no positive
    assert mined([(0, 1, [1.0], "", "", 0), (1, 1, [-1.0], "", "", 0), (2, 0, [-0.5], "", "", 0)]) == []  # a positive below zero has no window


def test_query(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duck.execute(llm.SQL["op13_hard_negatives"])
    names = [c[0] for c in want.description]
    out = entry.queries()["op13_hard_negatives"](spark, SF)
    assert sorted(out.columns) == sorted(names) and dict(out.dtypes)["rank"] == "int"
    rows = want.fetchall()
    assert sorted(tuple(r) for r in out.select(names).collect()) == sorted(rows) and len(rows) > 100
    vectors = duck.execute("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, embedding FROM embeddings").fetchall()
    assert sorted(rows) == sorted(brute(vectors, 100, 5, 10))
