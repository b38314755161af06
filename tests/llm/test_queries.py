"""The registered queries of the text operators, with their production parameters, on sf0.001 against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
from test_operators import brute_fingerprint, words
from tokenizers import Tokenizer

import __spark_entry__ as entry
from sparkledger.llm import license_scan, quality_rules

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(d.doc_id.tolist(), [t or "" for t in d.text], strict=True))


@pytest.fixture(scope="module")
def run(spark):
    def rows(name):
        out = entry.queries()[name](spark, SF)
        return {r["doc_id"]: r for r in out.collect()}, dict(out.dtypes)

    return rows


def test_op1(run, texts):
    got, types = run("op1_line_dedup")
    key = lambda x: x.strip(BLANKS).translate(ASCII_LOWER)
    holders = defaultdict(set)
    for k, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(k)
    keeper = {x: max(h) for x, h in holders.items() if len(h) >= 5}
    for k, t in texts.items():
        kept = [x for x in t.split("\n") if keeper.get(key(x), k) == k]
        n = len(t.split("\n"))
        assert (got[k]["n_lines"], got[k]["n_dropped"], got[k]["kept_sha256"]) == (n, n - len(kept), sha("\n".join(kept)))
    assert types["n_lines"] == types["n_dropped"] == "bigint" and len(got) == len(texts)


def test_op2(run, texts):
    got, types = run("op2_toxicity")
    assert got.keys() == texts.keys() and (types["held_out"], types["score"], types["predicted"]) == ("boolean", "double", "int")
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    same = defaultdict(set)
    for k, t in texts.items():
        same[t].add(got[k]["score"])
    assert all(len(s) == 1 for s in same.values())  # a score is of the text alone


def test_op3(run, texts):
    got, _ = run("op3_license_digest")
    known = {k: n for k, n, _ in license_scan.known_rows()}
    for k, t in texts.items():
        digest = sha(license_scan.canonical(t))
        lines = {sha(license_scan.canonical(x)) for x in t.split("\n") if license_scan.canonical(x)}
        assert (got[k]["text_digest"], got[k]["license"], got[k]["notices"]) == (digest, known.get(digest), ",".join(sorted({known[x] for x in lines if x in known})))


def test_op4_and_op8(run, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts, types = run("op4_token_counts")
    digests, _ = run("op8_bpe_encode_decode")
    for k, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (counts[k]["n_bytes"], counts[k]["n_tokens"], counts[k]["over_limit"]) == (len(t.encode()), len(ids), len(ids) > 512)
        r = digests[k]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    assert types["n_tokens"] == types["n_bytes"] == "bigint" and len(counts) == len(digests) == len(texts)


def test_op5(run, texts):
    got, _ = run("op5_simhash_dedup")
    marks = {k: brute_fingerprint(t) for k, t in texts.items()}
    root, changed = {k: k for k in marks}, True
    near = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{marks[k]:016x}", root[k]) for k in marks}


def test_op7(run, texts):
    got, _ = run("op7_quality_rules")
    source = dict(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "source"]).itertuples(index=False))
    line_of = lambda x: x.lower().strip(BLANKS)
    holders, hosts = defaultdict(set), defaultdict(set)
    for k, t in texts.items():
        hosts[source[k]].add(t)
        for x in filter(None, map(line_of, t.split("\n"))):
            holders[source[k], x].add(t)
    for k, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        repeated = len({i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)})
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        base = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        many = lambda x: len(holders[source[k], x]) >= max(quality_rules.LINE_DOCS, quality_rules.LINE_SHARE * len(hosts[source[k]]))  # noqa: B023, E731
        gone = sum(len(x.split()) for x in map(line_of, lines) if many(x))
        assert (r["base_failed"], r["kept"]) == (failed, not failed and len(w) - gone >= quality_rules.KEEP_SHARE * len(w))


def test_op9(run, texts):
    got, types = run("op9_slot_sharding")
    loads, slots = Counter(), defaultdict(list)
    for k, t in texts.items():
        r = got[k]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None) and 0 <= r["shard"] < 24
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(loads.values()) / 24, max(len(t.encode()) for t in texts.values()) + 8
    assert max(loads.values()) <= max(1.05 * mean, largest) and (types["slot"], types["shard"], types["grown_shard"]) == ("bigint", "int", "int")


def test_op10(run, texts):
    got, _ = run("op10_decontaminate")
    b = pd.read_parquet(f"{SF}/benchmark.parquet")
    windows = defaultdict(set)
    for i, t in zip(b.item_id, b.text, strict=True):
        w = words(t)
        for s in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[s : s + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    for k, t in texts.items():
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    items |= windows[tuple(w[s : s + n])]
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == sha(",".join(sorted(items))) and (r["longest"] or 0) >= 0 and (r["longest"] is None) == (not hit)
