"""The operators of sparkledger.llm against brute force on small fixtures: nulls, empty and long texts, ties, repeated
rows, empty tables and clashing columns."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from sparkledger.llm import chat_format, components, decontaminate, license_scan, line_dedup, quality_rules, sharding, simhash_dedup, token_dictionary, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{k % 977} thing{k % 13}" for k in range(6000))
SHARED = "This line of more than forty characters is found in many documents."
TEXTS = {
    1: f"one line\n{SHARED}\nend",
    2: f"  {SHARED.upper()}\t\nown text of document two",
    3: f"{SHARED}\n{SHARED}",
    4: f"x\n{SHARED}",
    5: f"{SHARED}\nlast",
    6: "",
    7: None,
    8: LONG,
    9: "the quick brown fox jumps over the lazy dog and runs far away from here to the hills",
    10: "the quick brown fox jumps over the lazy dog and runs far away from here to the hills",
    11: "Ünïcödé ß 你好 <|endoftext|> tail's  spaces \n\n\t x²½ ͸ ⃣ 12345",
}
DOCS = "doc_id long, text string, source string, row string, hash string, n_lines int, fp string, chunk string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "s", "clash", "clash", -1, "clash", "clash") for k, t in TEXTS.items()]
    rows += [rows[0], (None, "no id here", None, *rows[0][3:]), (None, None, None, *rows[0][3:])]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count()
    r = by_id(out)
    assert [r[k]["n_dropped"] for k in range(1, 8)] == [1, 1, 2, 1, 0, 0, 0]
    assert r[1]["text"] == "one line\nend" and r[3]["text"] == "" and r[5]["text"] == TEXTS[5] and r[7]["text"] is None
    assert r[6]["n_lines"] == r[7]["n_lines"] == 1 and r[2]["row"] == "clash"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_quality_counts(docs, empty):
    out = quality_rules.quality(docs)
    assert out.count() == docs.count() and quality_rules.quality(empty).count() == 0
    for k, r in by_id(out).items():
        t = TEXTS[k] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 999 else None
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        if repeated is not None:
            assert r["n_repeat_words"] == len(repeated)


def test_quality_many_repeats(spark):
    words = [f"w{k}" for k in range(60)] * 3 + ["own"] * 5
    r = quality_rules.quality(spark.createDataFrame([(1, " ".join(words), "s")], "doc_id long, text string, source string")).first()
    assert r["n_repeat_words"] == len(words) and r["base_failed"]


def test_boilerplate_rejects_depleted_documents_only(spark):
    menu = " ".join(f"menu{k}" for k in range(60))
    rows = [(k, f"{menu}\nown{k} text{k}", "a") for k in range(40)]
    rows += [(100 + k, f"{menu}\n" + " ".join(f"body{k}x{j}" for j in range(80)), "a") for k in range(40)]
    copy = "\n".join(" ".join(f"copy{i}x{j}" for j in range(30)) for i in range(4))
    rows += [(200 + k, copy, "b") for k in range(60)]
    r = by_id(quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not any(r[k]["kept"] for k in range(40))
    assert all(r[100 + k]["kept"] and r[100 + k]["n_removed_words"] == 60 for k in range(40))
    assert all(r[200 + k]["kept"] for k in range(60))


def test_shared_lines_with_one_own_line_are_boilerplate(spark):
    shared = "\n".join(f"shared{i} a{i} b{i}" for i in range(30))
    rows = [(k, f"{shared}\nown{k} c{k} d{k}", "a") for k in range(60)]
    rows += [(100 + k, " ".join(f"body{k}x{j}" for j in range(60)), "a") for k in range(200)]
    rows += [(400 + k, rows[60][1], "a") for k in range(2000)]  # copies of one text do not thin the share
    r = by_id(quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all(not r[k]["base_failed"] and not r[k]["kept"] and r[k]["n_removed_words"] == 90 for k in range(60))
    assert all(r[k]["kept"] for k in r if k >= 100)


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    out = simhash_dedup.near_components(docs)
    assert out.count() == docs.count() and simhash_dedup.near_components(empty).count() == 0
    r = by_id(out)
    for k, t in TEXTS.items():
        assert r[k]["fp"] % (1 << 64) == brute_fingerprint(t)
    assert r[10]["component_id"] == 9 and r[7]["component_id"] == 6 and r[8]["component_id"] == 8
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert 10 not in ids and 7 not in ids and ids.count(1) == 1 and {8, 9, 6, 11} <= set(ids)


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    marks = set(base)
    for b in base[:6]:  # dense groups, so that lists of more than two arise
        for _ in range(60):
            i, j, k = (int(x) for x in rng.integers(0, 16, 3))
            marks.add(b ^ (1 << i) ^ (1 << (j + 40)) ^ (1 << k))
    marks = sorted(marks)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash_dedup.near_links(spark.createDataFrame([(signed(x),) for x in marks], "fp long"))
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    a = np.array(marks, np.uint64)
    root = {signed(x): signed(x) for x in marks}
    changed = True
    near = [(signed(x), signed(marks[j])) for x in marks for j in np.flatnonzero(np.bitwise_count(a ^ np.uint64(x)) <= 2)]
    while changed:
        changed = False
        for u, v in near:
            m = min(root[u], root[v])
            if root[u] != m or root[v] != m:
                root[u] = root[v] = m
                changed = True
    assert all(got.get(x, x) == r for x, r in root.items())


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_tokens(docs, empty):
    tok = Tokenizer.from_file(PATH)
    counts, digests = by_id(token_dictionary.count_tokens(docs, PATH)), by_id(token_dictionary.encode_digests(docs, PATH))
    encoded = token_dictionary.encode_documents(docs, PATH)
    decoded = by_id(token_dictionary.decode_documents(encoded, PATH))
    for k, t in TEXTS.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert counts[k]["n_tokens"] == digests[k]["n_tokens"] == len(ids)
        assert digests[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert decoded[k]["text"] == tok.decode(ids, skip_special_tokens=False)
        assert digests[k]["decoded_sha256"] == hashlib.sha256(decoded[k]["text"].encode()).hexdigest()
    assert token_dictionary.count_tokens(empty, PATH).count() == token_dictionary.encode_digests(empty, PATH).count() == 0


def test_split_classes_equal_the_library():
    split, tok = token_dictionary.Splitter(PATH), Tokenizer.from_file(PATH)
    for c in map(chr, range(0x500)):
        text = f"a{c}{c}1 {c}\n{c} b's {c}{c} "
        assert split(text) == [text[i:j] for _, (i, j) in tok.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def longest_common(a, b, i, j):
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


ITEMS = [(1, TEXTS[9][4:]), (2, "ONE, line"), (3, None), (4, "..."), (5, TEXTS[9]), (None, "own text of"), (6, LONG[:200]), (7, "end"), (8, TEXTS[9][20:] + " " + TEXTS[9])]


@pytest.mark.parametrize("items", [ITEMS, [x for x in ITEMS if x[0] in (1, 5, 6, 8)]])
@pytest.mark.parametrize(("block_bytes", "shard_words"), [(1 << 20, 1 << 20), (1 << 20, 30), (150, 30), (1, 1)])
def test_decontaminate(spark, docs, empty, items, block_bytes, shard_words):
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    out = decontaminate.scan(docs, bench, block_bytes=block_bytes, shard_words=shard_words)
    assert out.count() == docs.count()
    clean = set()
    for k, r in by_id(out).items():
        w, hit, found, starts = words(TEXTS[k]), set(), set(), set()
        for g, who in windows.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found |= who
                    starts.add(s)
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(str(x) for x in found if x is not None))
        runs = [(longest_common(w, words(t), s, q), -s, min(10, len(words(t)))) for s in starts for _, t in items for q in range(len(words(t)))]
        best = max(x for x in runs if x[0] >= x[2]) if starts else (None, 0)
        assert (r["longest"], r["longest_pos"]) == (best[0], -best[1] if starts else None)
        if starts and r["longest_item"] is not None:
            t = words(dict(items)[int(r["longest_item"])])
            assert longest_common(w, t, r["longest_pos"], r["longest_item_pos"]) == r["longest"]
        if not hit:
            clean.add(k)
    kept = decontaminate.keep_clean(docs, bench, block_bytes=block_bytes, shard_words=shard_words)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"]} == clean
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == docs.count()


def test_scan_on_random_words_equals_plain_search(spark):
    rng = np.random.default_rng(2)  # few words, so that windows, runs and ties abound
    texts = [" ".join("abc"[x] for x in rng.integers(0, 3, rng.integers(0, 60))) for _ in range(40)]
    items = [(k, " ".join("abc"[x] for x in rng.integers(0, 3, rng.integers(0, 14)))) for k in range(25)]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for k, r in by_id(decontaminate.scan(docs, bench, window=4, block_bytes=100, shard_words=200)).items():
        w, hit, who, starts = texts[k].split(), set(), set(), set()
        for i, t in items:
            t = t.split()
            n = min(4, len(t))
            for q in range(len(t) - n + 1) if n else []:
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == t[q : q + n]:
                        hit |= set(range(s, s + n))
                        who.add(str(i))
                        starts.add(s)
        assert (r["n_hit"], r["items"]) == (len(hit), sorted(who))
        runs = [(longest_common(w, t.split(), s, q), -s, min(4, len(t.split()))) for s in starts for _, t in items for q in range(len(t.split()))]
        best = max(x for x in runs if x[0] >= x[2]) if starts else (None, 0)
        assert (r["longest"], r["longest_pos"]) == (best[0], -best[1] if starts else None)


@pytest.mark.parametrize("block_bytes", [60, 600])
def test_documents_are_read_as_often_for_many_blocks_as_for_few(spark, docs, block_bytes):
    """Once against the filter, and once for their numbers of words; blocks are searched in what the filter passes."""
    rows = [(k, f"filler {k} " * 12) for k in range(300)] + [(1000, TEXTS[9]), (1001, f"x {TEXTS[10]} y")]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"{w} {TEXTS[9]}") for k, w in enumerate("abcdefghijklmnop")], "item_id long, text string")
    read = source.mapInArrow(counted, source.schema)
    out = by_id(decontaminate.scan(read, bench, block_bytes=block_bytes))
    assert {k for k, r in out.items() if r["n_hit"]} == {1000, 1001} and len(out) == 302
    assert seen.value == 2 * len(rows)
    assert {r["doc_id"] for r in decontaminate.suspects(source, bench).collect()} == {1000, 1001}


@pytest.mark.parametrize(("block_bytes", "shard_words"), [(1 << 20, 1 << 20), (40, 20)])
def test_longest_match(spark, docs, block_bytes, shard_words):
    items = [(1, "zz " + TEXTS[9] + " qq"), (2, LONG[300:700]), (3, None), (4, LONG[300:420])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(int(x["item_id"]), x["item_pos"]): (x["n_words"], x["doc_id"], x["doc_pos"]) for x in decontaminate.longest_matches(docs, bench, block_bytes=block_bytes, shard_words=shard_words).collect()}
    split, want = {d: words(x) for d, x in TEXTS.items()}, {}
    for i, t in items:
        w = words(t)
        for q in range(len(w)):
            n, d, p = max((longest_common(w, x, q, p), -d, -p) for d, x in split.items() for p in range(len(x)))
            if n >= 10:
                want[i, q] = n, -d, -p
    assert got == want and got[1, 1] == (len(words(TEXTS[9])), 9, 0)


def test_toxicity(spark, empty):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        w = [f"w{x}" for x in rng.integers(0, 200, 30)]
        if k % 5 == 0:
            w.insert(7, ["scoundrel", "villainous"][k % 2])
        rows.append((k, " ".join(w), int(k % 5 == 0)))
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(1, None)], "doc_id long, toxic int")
    r = by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert sum((r[a]["score"] >= 0.3) == bool(c) for a, _, c in rows) > 590
    assert 0 <= r[9000]["score"] == r[9001]["score"] < 0.3
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_grams_equal_plain_n_grams():
    texts = ["", "a", "Ab cd", "  two  gaps, and-more ÜÑ_x9 ", "ß" * 3, LONG[:500], TEXTS[11]]
    for t in texts:
        ws = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in t.lower()).split(" ")
        want = {f" {w} "[i : i + n] for w in ws if w for n in toxicity.SIZES for i in range(len(w) + 3 - n)}
        got = toxicity.Distinct()(toxicity.grams(t))
        assert len(set(got.tolist())) == len(got) and abs(len(got) - len(want)) <= 1  # one collision is allowed for
        assert set(got.tolist()) == set(toxicity.grams(" ".join(reversed(ws))).tolist())


def test_toxicity_ratios_and_weights_against_a_plain_fit():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 6) + (40 if k % 3 == 0 else 0)) for k in range(90)]
    toxic = np.array([k % 3 == 0 for k in range(90)], np.uint8)
    found, lengths = np.concatenate(rows).astype(np.uint32), np.array([len(r) for r in rows])
    p, n = 30, 60
    a, scale = 2 * p / (p + n), {}
    for f in range(80):
        t, o = (sum(f in r for r, y in zip(rows, toxic, strict=True) if y == k) for k in (1, 0))
        r, e = np.log((t + a) / (p + 2)) - np.log((o + 2 - a) / (n + 2)), 1 / (t + a) + 1 / (o + 2 - a)
        scale[f] = r * (r * r / (r * r + 9 * e)) ** 2 if t + o else 0.0
    got = toxicity.ratios(*(np.bincount(found[np.repeat(toxic == k, lengths)], minlength=80) for k in (1, 0)), p, n)
    assert np.allclose(got, [scale[f] for f in range(80)])
    m = toxicity.fit_rows(found, lengths, toxic, passes=200)
    x = np.array([[scale[f] * (f in r) for f in range(80)] + [1.0] for r in rows])  # the plain fit: gradient descent
    w, y = np.zeros(81), toxic.astype(float)
    for _ in range(20000):
        w -= 0.002 * (w + toxicity.LOSS * x.T @ (1 / (1 + np.exp(-x @ w)) - y))
    score = x @ w
    mine = [m.intercept + float(m.weights[r].sum()) for r in rows]
    assert np.allclose(mine, score, atol=0.02)
    assert np.count_nonzero(m.weights) == np.count_nonzero(list(scale.values()))  # no feature is left out


def test_sharding(spark, docs, empty, tmp_path):
    hot = spark.createDataFrame([(None, "hot")] * 3000, "doc_id long, text string")
    for d, shards, slots in ((docs, 3, 64), (docs.select("doc_id", "text").unionByName(hot), 3, 64)):
        folder = str(tmp_path / f"maps{d.count()}")
        out = sharding.shard_documents(d, shards, folder, slots).collect()
        assert sharding.latest_version(spark, folder) == 2  # the even map, and its edit
        want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in d.collect())
        assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == want
        for shard in {r["shard"] for r in out}:
            assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
        stored = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, folder, 2).collect()}
        assert all(stored[r["virtual_slot"]] == r["shard"] for r in out) and len(stored) == slots
    assert len({r["virtual_slot"] for r in out if r["size"] == 11}) == 64  # a row repeated three thousand times does not stay in one slot
    assert sharding.shard_documents(empty, 3, str(tmp_path / "none"), 64).count() == 0


@pytest.mark.parametrize("copies", [7, 1 << 16])
def test_a_records_slot_never_changes(spark, docs, monkeypatch, copies):
    """It depends on the record and its number among its equals, not on the load of its slot or on where it is read."""
    monkeypatch.setattr(sharding, "COPIES", copies)
    hot = lambda n: spark.createDataFrame([(None, "hot")] * n + [(5, "x")] * (n // 10), "doc_id long, text string")
    slots = lambda d: Counter((r["doc_id"], r["text_crc32"], r["virtual_slot"]) for r in sharding.records(d, 64).collect())
    few, many = (docs.select("doc_id", "text").unionByName(hot(n)) for n in (40, 900))
    a, b, c = slots(few), slots(many), slots(many.repartition(7))
    assert b == c and not a - b and (b - a).total() == 860 + 86


def test_rebalance_moves_little():
    loads = {s: 100 + s % 7 for s in range(64)}
    old = sharding.rebalanced(sharding.even_map(4, 64), loads, 4)
    assert sharding.rebalanced(old, loads, 4) == old
    grown = sharding.rebalanced(old, loads, 5)
    moved = [s for s in old if old[s] != grown[s]]
    assert {grown[s] for s in moved} == {4} and len(moved) <= 16
    assert set(sharding.rebalanced(old, loads, 3).values()) == {0, 1, 2}


def test_map_versions(spark, tmp_path):
    sharding.store_map(spark, {0: 1, 1: 0}, str(tmp_path), 1)
    sharding.store_map(spark, {0: 1, 1: 1}, str(tmp_path), 2)
    assert {tuple(r) for r in sharding.load_map(spark, str(tmp_path), 1).collect()} == {(0, 1), (1, 0)}


def test_licenses(spark, docs, empty):
    body = dict(license_scan.known_texts())
    mit, isc = ((license_scan.Path(license_scan.__file__).parent / f"licenses/{x}.txt").read_text() for x in ("MIT", "ISC"))
    wrap = lambda t, n: "\n".join(x for p in t.split("\n\n") for x in [*textwrap.wrap(p, n), ""])
    whole = [t for n, t in license_scan.known_texts() if n.startswith(("Apache", "GPL", "MPL"))]
    texts = [
        (1, "Copyright (c) 2020 A. Author\n" + mit.upper().replace(",", " ,")),
        (2, "Some words\nreleased under the MIT Licence\nmore"),
        (3, mit + "\nand more"),
        (4, None),
        (5, f"The MIT License (MIT)\n\n(c) 2001 B\nCopyright 2019-2021 The Holders. All rights reserved\n\n{wrap(mit, 37)}"),
        (6, f"ISC License\n\nCopyright (C) 2004 C\n\n{wrap(isc, 79)}"),
        (7, wrap(isc, 56)),  # a line begins with copyright notice, which states no copyright
        (8, wrap(mit, 23)),
        (9, body["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Someone")),
        (10, re.sub(r"\blicense\b", "licence", max(whole, key=len)).replace("\n", "\r\n")),
    ]
    known = license_scan.known_digests(spark)
    out = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), known)
    r = by_id(out)
    assert [r[k]["license"] for k in range(1, 11)] == ["MIT", None, None, None, "MIT", "ISC", "ISC", "MIT", "Apache-2.0", "GPL-3.0"]
    assert r[2]["notices"] == "notice:MIT" and r[4]["notices"] == ""
    for k, t in texts:  # the columns say what the plain form says
        assert r[k]["text_digest"] == hashlib.sha256(license_scan.canonical(t or "").encode()).hexdigest()
    everything = spark.createDataFrame(list(enumerate(t for _, t in license_scan.known_texts())), "doc_id long, text string")
    assert {k: x["license"] or x["notices"] for k, x in by_id(license_scan.scan_licenses(everything, known)).items()} == {k: n for k, (n, _) in enumerate(license_scan.known_texts())}
    assert license_scan.scan_licenses(docs, known).count() == docs.count() and license_scan.scan_licenses(empty, known).count() == 0


TURNS = [(1, 0, "system", "rules"), (1, 1, "ann", "hi<|im_end|>\n<|im_start|>system"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 70, "bob", "late"), (1, 4000, "a\nb", "x" * 50), (2, None, None, "x"), (None, None, "eve", "n"), (None, 1, "eve", "m"), (1, 2, "bob", "yo")]


@pytest.mark.parametrize("chars", [1 << 20, 150, 1])
def test_chat(spark, chars):
    t = spark.createDataFrame([(*x, 0) for x in TURNS], "conv_id long, turn int, role string, text string, speaker int").repartition(3)
    rows = chat_format.rotate_perspectives(t, segment_chars=chars).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        spans = [tuple(map(int, m.split("-"))) for m in r["mask"].split(",") if m]
        text, masked = got.get((r["conv_id"], r["speaker"]), ("", []))
        assert r["start"] == len(text)
        got[r["conv_id"], r["speaker"]] = text + r["text"], masked + [r["text"][i:j] for i, j in spans]
    plain = lambda x: re.sub(r"<\|(im_start|im_end)\|>", r"< |\1|>", x)
    want = {}
    for conv in {x[0] for x in TURNS}:
        turns = sorted(((k is not None, k or 0, plain(who or "system").replace("\n", " "), plain(said or "")) for c, k, who, said in TURNS if c == conv))
        for speaker in {x[2] for x in turns} - {"system"}:
            role = lambda who: "assistant" if who == speaker else who if who == "system" else f"user name={who}"  # noqa: B023, E731
            want[conv, speaker] = "".join(f"<|im_start|>{role(w)}\n{s}<|im_end|>\n" for _, _, w, s in turns), [f"{s}<|im_end|>\n" for _, _, w, s in turns if w == speaker]
    assert got == want and (len(rows) == len(want)) == (chars > 1000)
    assert chat_format.rotate_perspectives(t.limit(0)).count() == 0
