"""Benchmark decontamination with suffix arrays of the training text.

Each task reads whole documents into shards of bounded size and builds a suffix array over each shard's words. Every
suffix of the benchmark is binary-searched in it, which gives its longest verbatim match and the place of that match;
the searches with a suffix's first words (a window) give every place where the window occurs, and so the words hit and
the documents affected. Because a document lies in one shard, these places settle its hits; matches of one benchmark
suffix in several shards are compared afterwards.

A shard's suffix array is sparse: a match lies inside a run of words of which each neighbouring pair occurs in the
benchmark, so only such runs of enough words are sorted, each suffix to the end of its run.

The benchmark goes to the tasks in blocks of BLOCK_BYTES of text (more only where one item is larger): the driver reads
it a part at a time and cuts it there, and each block is dropped before the next. One block takes one pass over the
documents and no shuffle. Where there are several, the documents are read once, against a filter of the word pairs of all
blocks (PAIR_BITS bits, whatever the benchmark's size): a document without a run of pairs long enough for the
shortest window has no match. The others are written to the shared folder, and each block takes a pass over those only;
its hits are written too and put together by row.

Defined results: a null or wordless document has no words and is never contaminated; a null or wordless item has no
window; an item with a null item_id marks words as hit but is not listed; of equally long matches a document's first
is given, with the smallest item_id that has it; repeated rows each get their own result row; empty tables give an
empty result, or no hits; columns other than those named are passed through or not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import free_name, materialise, row_key

WINDOW = 10
#: Words of training text in a shard's suffix array, unless one document has more.
SHARD_WORDS = 1_500_000
#: Bytes of benchmark text that a block, and so a task, holds at most (unless one item has more).
BLOCK_BYTES = 4 << 20
#: Bits of the filter of word pairs. A window of ten words has nine pairs in a row, so that a filter half full still
#: passes no more than one place in 512 by chance.
PAIR_BITS = 1 << 27
#: Words that a comparison of suffixes looks at together.
STEP = 16

# Word characters are 0-9, a-z (A-Z lower-cased) and all bytes from x80; the rest separates words.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The same words as a pattern over texts that are not lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

Item = tuple[str | None, str | None]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


def left_in_run(text: np.ndarray) -> np.ndarray:
    """For each place the number of words from there to the next 0."""
    ends = np.flatnonzero(text == 0)
    return (ends[np.searchsorted(ends, np.arange(len(text)))] if len(ends) else np.zeros(0, np.int64)) - np.arange(len(text))


class Suffixes:
    """The suffix array of words given as numbers above 0, with a 0 after each run; a suffix ends before the next 0."""

    def __init__(self, text: np.ndarray):
        self.text = np.concatenate([text.astype(np.int64), np.zeros(STEP, np.int64)])
        rank, left, k = text.astype(np.int64), left_in_run(text), 1
        while k < left.max(initial=0):  # the order by k words gives that by 2k
            after = np.zeros_like(rank)
            after[:-k] = rank[k:]
            after[left <= k] = 0
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1]
            k *= 2
        places = np.flatnonzero(text)
        self.order = places[np.argsort(rank[places], kind="stable")]

    def _common(self, at: np.ndarray, other: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many words the suffixes at these places share with those that start in other, which ends like text."""
        n, open_, span = np.zeros(len(at), np.int64), np.arange(len(at)), np.arange(STEP)
        while len(open_):
            mine = self.text[(at[open_] + n[open_])[:, None] + span]
            same = (mine == other[(starts[open_] + n[open_])[:, None] + span]) & (mine > 0)
            whole = same.all(axis=1)
            n[open_] += np.where(whole, STEP, same.argmin(axis=1))
            open_ = open_[whole]
        return n

    def bound(self, other: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        """By binary search, how many suffixes stand before the first lengths words from each start, or up to their end."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            at, start = self.order[mid], starts[open_]
            n = np.minimum(self._common(at, other, start), lengths[open_])
            equal = n == lengths[open_]
            less = np.where(equal, after, self.text[at + n] < other[start + n])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low

    def longest(self, other: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, where): the longest match of the suffixes from starts, whose places in the order are given, and a suffix that has it."""
        n, where = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for side in (places - 1, places):
            ok = np.flatnonzero((side >= 0) & (side < len(self.order)))
            at = self.order[side[ok]]
            m = self._common(at, other, starts[ok])
            better = m > n[ok]
            n[ok[better]], where[ok[better]] = m[better], at[better]
        return n, where


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, j): every j from first[k] to last[k], end excluded."""
    count = last - first
    k = np.repeat(np.arange(len(first)), count)
    return k, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[k]


class Block:
    """A part of the benchmark: its words, its suffixes in order, and its different windows with the items that hold them."""

    def __init__(self, items: list[Item], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        held = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]) for i, t in items if (ws := words(t))]
        self.ids = [i for i, _ in held]
        lengths = np.array([len(ws) for _, ws in held], np.int64)
        text = np.array([w for _, ws in held for w in [*ws, 0]], np.int64)
        self.suffixes, self.begin = Suffixes(text), np.concatenate([[0], np.cumsum(lengths + 1)])
        self.left = left = left_in_run(text)
        self.pairs = self._pairs(text)
        # A window is named by the first suffix that starts with it: equal windows are neighbours in the order.
        order = self.suffixes.order
        need = np.minimum(window, lengths)[np.searchsorted(self.begin, order, "right") - 1] if len(order) else order
        order, need = order[left[order] >= need], need[left[order] >= need]
        self.least = int(need.min()) if len(need) else 0
        self.windows: list[tuple[np.ndarray, np.ndarray, list[set[int]]]] = []
        for n in np.unique(need).tolist():  # items shorter than a window have windows of their own length
            at = order[need == n]
            same = self.suffixes._common(at[:-1], self.suffixes.text, at[1:]) >= n
            number = np.cumsum(np.concatenate([[True], ~same])) - 1
            owners: list[set[int]] = [set() for _ in range(number[-1] + 1)]
            for k, item in zip(number.tolist(), (np.searchsorted(self.begin, at, "right") - 1).tolist(), strict=True):
                owners[k].add(item)
            starts = at[np.concatenate([[True], ~same])]
            self.windows.append((starts, np.full(len(starts), n), owners))

    @staticmethod
    def _pairs(text: np.ndarray) -> np.ndarray:
        both = (text[:-1] > 0) & (text[1:] > 0)
        return np.unique(text[:-1][both] << 32 | text[1:][both])

    def runs(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words with a 0 after each run, their places in text): the runs that a match can lie in."""
        known = text > 0
        linked = known[:-1] & known[1:]
        if self.least > 1:
            at = np.flatnonzero(linked)
            pairs = text[at] << 32 | text[at + 1]
            near = np.searchsorted(self.pairs, pairs)
            linked[at] = self.pairs[np.minimum(near, len(self.pairs) - 1)] == pairs if len(self.pairs) else False
        edge = np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # end is the run's last word
        if self.least == 1:
            alone = np.flatnonzero(known & ~np.concatenate([[False], linked]) & ~np.concatenate([linked, [False]]))
            begin, end = np.concatenate([begin, alone]), np.concatenate([end, alone])
        long = end - begin + 1 >= max(self.least, 1)
        begin, end = np.sort(begin[long]), np.sort(end[long])
        _, places = _spread(begin, end + 2)  # one more place for the 0
        out = text[np.minimum(places, len(text) - 1)]
        out[np.cumsum(end - begin + 2) - 1] = 0
        return out, places


@dataclass
class Found:
    """What a shard has found in one document."""

    n_words: int
    spans: list[tuple[int, int]] = field(default_factory=list)
    items: set[int] = field(default_factory=set)
    #: (words, place in the document, place in the block's text) of the longest match.
    longest: tuple[int, int, int] | None = None


class Shard:
    """Whole documents as word numbers, a 0 after each, and the suffix array of their runs."""

    def __init__(self, block: Block, texts: list[list[bytes]]):
        get = block.vocabulary.get
        self.block, self.lengths = block, np.array([len(ws) for ws in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        text = np.zeros(self.begin[-1], np.int64)
        for a, ws in zip(self.begin.tolist(), texts, strict=False):
            text[a : a + len(ws)] = [get(w, 0) for w in ws]
        runs, self.places = block.runs(text) if block.least and len(text) else (np.zeros(0, np.int64),) * 2
        self.suffixes = Suffixes(runs) if len(runs) else None

    def _document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1

    def _reach(self) -> np.ndarray:
        """For each place of the block the words from there of which each neighbouring pair occurs in the runs."""
        text, pairs = self.block.suffixes.text, Block._pairs(self.suffixes.text)
        seen = np.zeros(len(self.block.vocabulary) + 1, bool)
        seen[self.suffixes.text] = True
        seen[0] = False
        both = text[:-1] << 32 | text[1:]
        near = np.minimum(np.searchsorted(pairs, both), max(len(pairs) - 1, 0))
        broken = np.flatnonzero(np.concatenate([pairs[near] != both if len(pairs) else np.ones(len(both), bool), [True]]))
        return np.where(seen[text], broken[np.searchsorted(broken, np.arange(len(text)))] - np.arange(len(text)) + 1, 0)

    def documents(self) -> list[Found]:
        out = [Found(n) for n in self.lengths.tolist()]
        if self.suffixes is None:
            return out
        theirs, edges, reach = self.block.suffixes.text, np.zeros(self.begin[-1] + 1, np.int64), self._reach()
        n, where = np.zeros(len(self.suffixes.order), np.int64), np.zeros(len(self.suffixes.order), np.int64)
        for starts, need, owners in self.block.windows:
            can = np.flatnonzero(reach[starts] >= need)
            starts, need = starts[can], need[can]
            first, last = (self.suffixes.bound(theirs, starts, need, after) for after in (False, True))
            k, j = _spread(first, last)
            at = self.suffixes.order[j]
            place = self.places[at]
            np.add.at(edges, place, 1)
            np.add.at(edges, place + need[k], -1)
            n[j], where[j] = need[k], starts[k]  # the longest window comes last
            for d, w in set(zip(self._document(place).tolist(), can[k].tolist(), strict=True)):
                out[d].items |= owners[w]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(edges) > 0])))
        for a, b, d in zip(turns[::2].tolist(), turns[1::2].tolist(), self._document(turns[::2]).tolist(), strict=True):
            out[d].spans.append((a - int(self.begin[d]), b - int(self.begin[d])))
        order = self.block.suffixes.order
        self._longest(out, n, where, order[reach[order] >= self.block.least])
        return out

    def _longest(self, out: list[Found], n: np.ndarray, where: np.ndarray, starts: np.ndarray) -> None:
        """The longest match of each document: a window at least. n and where have the longest window that each suffix starts
        with; whole windows grow to the match with the nearest of the block's suffixes from starts."""
        touched = np.flatnonzero(n)
        at, n, where, theirs = self.suffixes.order[touched], n[touched], where[touched], self.block.suffixes
        before = self.suffixes.bound(theirs.text, starts, self.block.left[starts], False)
        # The block's suffixes next to one of ours are those up to it and the first after it.
        near = np.searchsorted(before, touched, "right")
        for side in (near - 1, near):
            ok = np.flatnonzero((side >= 0) & (side < len(starts)))
            m = theirs._common(starts[side[ok]], self.suffixes.text, at[ok])
            better = (m > n[ok]) & (m >= self.block.window)
            n[ok[better]], where[ok[better]] = m[better], starts[side[ok]][better]
        place = self.places[at]
        for d, m, p, s in zip(self._document(place).tolist(), n.tolist(), place.tolist(), where.tolist(), strict=True):
            p -= int(self.begin[d])
            if out[d].longest is None or (-m, p) < (-out[d].longest[0], out[d].longest[1]):
                out[d].longest = m, p, s

    def matches(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, place in it, document, place in it, words) for each suffix of the block that matches a window or more:
        its longest match, at the first place of the shard."""
        if self.suffixes is None:
            return
        theirs, order = self.block.suffixes.text, self.block.suffixes.order
        starts = order[self._reach()[order] >= self.block.least]
        item = np.searchsorted(self.block.begin, starts, "right") - 1
        need = np.minimum(self.block.window, np.diff(self.block.begin)[item] - 1)
        n, _ = self.suffixes.longest(theirs, starts, self.suffixes.bound(theirs, starts, self.block.left[starts], False))
        ok = n >= need
        starts, n, item = starts[ok], n[ok], item[ok]
        first, last = (self.suffixes.bound(theirs, starts, n, after) for after in (False, True))
        k, j = _spread(first, last)
        place = np.full(len(starts), self.begin[-1])
        np.minimum.at(place, k, self.places[self.suffixes.order[j]])
        doc = self._document(place)
        yield from zip(item.tolist(), (starts - self.block.begin[item]).tolist(), doc.tolist(), (place - self.begin[doc]).tolist(), n.tolist(), strict=True)


_held: dict[int, Block] = {}


def _block(items: Broadcast, window: int) -> Block:
    """A worker builds a block once, and keeps only the last."""
    if items.value is not _held.get("items"):
        _held.clear()
        _held.update(items=items.value, block=Block(items.value, window))
    return _held["block"]


def shards(batches: Iterator[pa.RecordBatch], block: Block, shard_words: int) -> Iterator[tuple[pa.Table, Shard]]:
    """Rows in shards of about shard_words words, with their texts' suffix arrays."""
    rows, texts, total = [], [], 0
    for batch in batches:
        begin = 0
        for k, t in enumerate(batch["text"]):
            ws = words(t.as_py())
            if total and total + len(ws) > shard_words:
                rows.append(batch.slice(begin, k - begin))
                yield pa.Table.from_batches(rows), Shard(block, texts)
                rows, texts, total, begin = [], [], 0, k
            texts.append(ws)
            total += len(ws)
        rows.append(batch.slice(begin))
    if texts:
        yield pa.Table.from_batches(rows), Shard(block, texts)


def blocks(bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Item]]:
    """The benchmark in blocks of block_bytes of text at most, unless one item has more. A part of the table at a time is read."""
    out, size = [], 0
    for r in bench.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        n = len((r["text"] or "").encode())
        if out and size + n > block_bytes:
            yield out
            out, size = [], 0
        out.append((r["item_id"], r["text"]))
        size += n
    yield out


def _places(hashes: np.ndarray, pairs: bool) -> np.ndarray:
    """The filter's bits of neighbouring words, or of single ones, by the hashes of the words."""
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    x = (hashes[:-1] * a) ^ (hashes[1:] + b) if pairs else hashes + a
    x = (x ^ (x >> np.uint64(29))) * b
    return ((x ^ (x >> np.uint64(32))) * a >> np.uint64(20)).astype(np.int64) % PAIR_BITS


def _hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(crc32, words(text)), np.uint64)


def suspects(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) of the rows of docs in which a window can occur, written once; docs is read once.

    The filter's set words of 64 bits come to the driver, PAIR_BITS / 64 of them at most, and are broadcast."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN))
    least = bench.agg(F.min(F.when(n > 0, F.least(n, F.lit(window))))).first()[0] or 0

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_places(h, least > 1) for h in map(_hashes, batch["text"].to_pylist()) if len(h)]
            places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            at, first = np.unique(places >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["at", "bits"])

    marked = bench.select("text").mapInArrow(mark, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(PAIR_BITS >> 6, np.uint64)
    bits[marked["at"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def suspect(texts: pa.Array) -> pa.Array:
        out = []
        for h in map(_hashes, texts.to_pylist()):
            if not least or len(h) < least:
                out.append(False)
                continue
            places, row = _places(h, least > 1), max(least - 1, 1)
            known = (held.value[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
            total = np.concatenate([[0], np.cumsum(known.astype(np.int64))])
            out.append(bool((total[row:] - total[:-row] == row).any()))
        return pa.array(out, pa.bool_())

    return materialise(docs.select("doc_id", "text").where(suspect(F.col("text"))))


_FOUND = "spans array<struct<a: bigint, b: bigint>>, items array<string>, longest struct<n: bigint, back: bigint, item: string, item_pos: bigint>"


def _search(docs: DataFrame, items: Broadcast, window: int, shard_words: int, hits_only: bool) -> DataFrame:
    """(row, doc_id, n_words, spans, items, longest) for each row of docs, or for those with a hit."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    best = pa.struct([("n", pa.int64()), ("back", pa.int64()), ("item", pa.string()), ("item_pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(items, window)
        for rows, shard in shards(batches, block, shard_words):
            found = shard.documents()
            keep = [k for k, f in enumerate(found) if f.spans or not hits_only]
            listed = [sorted({block.ids[i] for i in found[k].items if block.ids[i] is not None}) for k in keep]
            longest = []
            for f in (found[k].longest for k in keep):
                if f is None:
                    longest.append(None)
                    continue
                n, p, s = f
                low, high = (int(block.suffixes.bound(block.suffixes.text, np.array([s]), np.array([n]), x)[0]) for x in (False, True))
                equal = block.suffixes.order[low:high]
                at = np.searchsorted(block.begin, equal, "right") - 1
                name, pos = min(((block.ids[i] is None, block.ids[i] or "", q) for i, q in zip(at.tolist(), (equal - block.begin[at]).tolist(), strict=True)), default=(True, "", 0))[1:]
                longest.append({"n": n, "back": -p, "item": name or None, "item_pos": pos})
            spans = [[{"a": a, "b": b} for a, b in found[k].spans] for k in keep]
            cols = [pa.array([found[k].n_words for k in keep], pa.int64()), pa.array(spans, span), pa.array(listed, pa.list_(pa.string())), pa.array(longest, best)]
            of = rows.select(["row", "doc_id"]).take(pa.array(keep, pa.int64())).combine_chunks()
            yield from pa.table([*of.columns, *cols], names=["row", "doc_id", "n_words", "spans", "items", "longest"]).to_batches()

    d = docs.select(row_key().alias("row"), "doc_id", "text")
    return d.mapInArrow(run, f"row string, doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, {_FOUND}")


def _by_block(docs: DataFrame, bench: DataFrame, block_bytes: int, search: Callable[[Broadcast], DataFrame]) -> tuple[DataFrame, bool]:
    """(what search finds with all blocks, whether there were several). With several, each block's rows are written, and the block dropped."""
    context, parts, held = docs.sparkSession.sparkContext, blocks(bench, block_bytes), None
    first = context.broadcast(next(parts))
    for items in parts:
        held = materialise(search(first)) if held is None else held
        part = context.broadcast(items)
        held = held.unionByName(materialise(search(part)))
        part.destroy()
    return (search(first), False) if held is None else (held, True)


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items, longest, longest_pos, longest_item, longest_item_pos) for each row of docs.

    items are the ids of the items found; longest is the length in words of the longest verbatim match, at longest_pos
    of the document and longest_item_pos of the item (null where no window occurs)."""
    bench = bench.select("item_id", "text")
    several = _several(bench, block_bytes)
    source = suspects(docs, bench, window) if several else docs
    out, several = _by_block(docs, bench, block_bytes, lambda items: _search(source, items, window, shard_words, several))
    if several:
        found = out.groupBy("row").agg(
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.max_by("longest", F.struct("longest.n", "longest.back")).alias("longest"),
        )
        n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long")
        out = docs.select(row_key().alias("row"), "doc_id", n_words.alias("n_words")).join(found, "row", "left")
        empty = F.array()
        out = out.withColumns({"spans": F.coalesce("spans", empty.cast(found.schema["spans"].dataType)), "items": F.coalesce("items", empty.cast("array<string>"))})
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    n_hit = F.aggregate("spans", start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")), lambda s: s["n"])
    best = F.col("longest")
    return out.select(
        "row", "doc_id", "n_words", n_hit.alias("n_hit"), "items", best["n"].alias("longest"), (-best["back"]).alias("longest_pos"), best["item"].alias("longest_item"), best["item_pos"].alias("longest_item_pos")
    )


def _several(bench: DataFrame, block_bytes: int) -> bool:
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size > block_bytes and bench.limit(2).count() > 1


def keep_clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with the columns of docs."""
    bench = bench.select("item_id", "text")
    if _several(bench, block_bytes):
        source = suspects(docs, bench, window)
        hit = _by_block(docs, bench, block_bytes, lambda items: _search(source, items, window, shard_words, True))[0]
        row = free_name(docs, "row")
        return docs.withColumn(row, row_key()).join(hit.select(F.col("row").alias(row)).distinct(), row, "left_anti").select(docs.columns)

    def clean(items: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, shard in shards(batches, _block(items, window), shard_words):
                yield from rows.filter(pa.array([not f.spans for f in shard.documents()], pa.bool_())).to_batches()

        return docs.mapInArrow(run, T.StructType(docs.schema.fields))

    return _by_block(docs, bench, block_bytes, clean)[0]


def longest_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(item_id, item_pos, doc_id, doc_pos, n_words): for each benchmark suffix that matches a window or more, its longest
    verbatim match in the training text and the first place of it (by doc_id), compared over all shards."""
    source = suspects(docs, bench.select("item_id", "text"), window) if _several(bench, block_bytes) else docs

    def search(items: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _block(items, window)
            for rows, shard in shards(batches, block, shard_words):
                ids, got = rows["doc_id"].combine_chunks(), list(shard.matches())
                docs_ = ids.take(pa.array([g[2] for g in got], pa.int64()))
                cols = [pa.array([block.ids[g[0]] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), docs_, *(pa.array([g[k] for g in got], pa.int64()) for k in (3, 4))]
                yield from pa.table(cols, names=["item_id", "item_pos", "doc_id", "doc_pos", "n_words"]).to_batches()

        kind = dict(docs.dtypes)["doc_id"]
        return source.select("doc_id", "text").mapInArrow(run, f"item_id string, item_pos bigint, doc_id {kind}, doc_pos bigint, n_words bigint")

    out = _by_block(docs, bench, block_bytes, search)[0]
    first = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("x"), "doc_id", "doc_pos")).alias("b")
    return out.groupBy("item_id", "item_pos").agg(first).select("item_id", "item_pos", "b.doc_id", "b.doc_pos", (-F.col("b.n")).alias("n_words"))
