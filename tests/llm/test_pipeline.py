"""The pipeline against a plain version on sf0.001, and its stages on awkward rows."""

import hashlib
import re

import corpus_pipeline
import pandas as pd
import public_tokenizers
import pytest
from test_operators import brute_fingerprint, words
from tokenizers import Tokenizer

from sparkledger.llm import _common

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(BLANKS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_run_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text.to_dict()
    kept = {}
    for k, t in docs.items():  # no host reaches the line limits at this size
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen, repeated = {}, set()
        for i, g in enumerate(grams):
            seen.setdefault(g, []).append(i)
        for at in seen.values():
            if len(at) > 1:
                repeated |= {i + j for i in at for j in range(3)}
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w):
            kept[k] = t
    holders = {}
    for k, t in kept.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(k)
    gone = {x: max(h) for x, h in holders.items() if len(h) >= 5}
    kept = {k: "\n".join(x for x in t.split("\n") if gone.get(key(x), k) == k) for k, t in kept.items()}
    marks = {k: brute_fingerprint(t) for k, t in kept.items()}
    root = {k: k for k in marks}
    for _ in range(5):
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    kept = {k: t for k, t in kept.items() if root[k] == k}
    windows = set()
    for t in pd.read_parquet(f"{SF}/benchmark.parquet").text:
        w = words(t)
        windows |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    kept = {k: t for k, t in kept.items() if not any(tuple(w[s : s + n]) in windows for w in [words(t)] for n in sizes for s in range(len(w) - n + 1))}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: hashlib.sha256(",".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for k, t in kept.items()}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    left = len(_common.tables())
    corpus_pipeline.run(spark, SF).count()
    assert len(_common.tables()) <= left + 1  # a run leaves its last table only


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_rows(spark, stage):
    own = ["kept", "row", "__row", "bitmap", "__bitmap", "n", "__n", "n_lines", "n_dropped", "host", "line", "digest", "fp", "component_id", "spans", "ROW"]
    rows = [(*r, *["x"] * len(own)) for r in [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "word " * 60, "en", "a", 300), (2, "word " * 60, "en", "a", 300)]]
    long = " ".join(f"w{k * k % 50_021}" for k in range(25_000))  # a very long text, and one that ties with it
    rows += [(k, long, "en", "a", len(long), *["x"] * len(own)) for k in (4, 3)]
    own[-1] = "Hash"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own))
    f = corpus_pipeline.STAGES[stage][1]
    out = f(spark, docs, SF)
    assert f(spark, docs.limit(0), SF).count() == 0
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and all(r[c] == "x" for r in out.collect() for c in own)
    got = out.collect()
    assert len(got) == (2, 6, 3, 6, 6)[stage]
    if stage == 2:  # of equal fingerprints the smallest id stays
        assert {r["doc_id"] for r in got if r["text"] == long} == {3}
