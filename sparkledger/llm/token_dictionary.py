"""Token counts, encoding and decoding through a table of distinct words.

Pre-tokens ("words") repeat so much that only distinct ones are worth encoding. One pass over whole documents forms
chunks of bounded size: a chunk holds its distinct words once, and for each document either the word numbers in
order (encoding) or number-and-frequency pairs (counting), compressed. Chunks are shuffled once by their name and
that exchange feeds two branches: the words go on to buckets by hash, where each distinct word of the corpus is
encoded once, and the answers come back to the chunk, where they are joined to the documents by word number.

A word that is in every document is one entry of each chunk, so no key gathers the corpus. A chunk's name is a hash
of what is in it: should a lost chunk be rebuilt from rows in another order, its answers are missed and the job
fails rather than mixing two versions.

Results equal those of the tokenizers library (no added begin or end tokens; special strings inside a text are
special tokens, as by its default). The split pattern is that of the byte-level vocabularies. Up to U+04FF it runs
as a pattern of fixed character classes; texts with characters beyond are split by the library itself, because
Unicode versions differ on characters beyond that.

Defined results: a null text is an empty one, with no tokens; repeated rows each get their own result row; an empty
table gives an empty result; a text longer than a chunk is a chunk of its own, whole; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Characters of text in a chunk, unless one document has more.
CHUNK_CHARS = 16 << 20

# Letters, numbers and white space among the characters up to U+04FF.
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
_PLAIN = re.compile("[\x00-ӿ]*")
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W{_NUMBERS}_]+| ?[{_NUMBERS}]+| ?(?:(?![{_SPACES}{_NUMBERS}])(?:\W|_))+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class Splitter:
    """A text's pre-tokens, with special strings whole."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return [w for k, part in enumerate(self.special.split(text)) for w in ([part] if k % 2 else self._plain(part))]


def _pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def _unpack(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _chunk(part: int, number: int, ids: list, sizes: list[int], words: list[str], numbers: list[np.ndarray], counts: list[np.ndarray] | None) -> tuple[str, bytes, bytes]:
    body = _pack((ids, sizes, [len(x) for x in numbers], _small(np.concatenate(numbers)), _small(np.concatenate(counts)) if counts else None))
    dictionary = _pack(words)
    name = hashlib.md5(f"{part},{number},".encode() + dictionary + body).hexdigest()
    return name, dictionary, body


def chunks(docs: DataFrame, path: str, frequencies: bool) -> DataFrame:
    """(chunk, payload): the chunks of docs, shuffled by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, number = Splitter(path), TaskContext.get().partitionId(), 0

        def fresh():
            seen = defaultdict()
            seen.default_factory = seen.__len__
            return [], [], seen, [], []

        def done(state):
            ids, sizes, seen, numbers, counts = state
            name, dictionary, body = _chunk(part, number, ids, sizes, list(seen), numbers, counts)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pickle.dumps((dictionary, body))], pa.binary())], ["chunk", "payload"])

        state, chars = fresh(), 0
        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                t = text.as_py() or ""
                if chars and chars + len(t) > CHUNK_CHARS:
                    yield done(state)
                    state, chars, number = fresh(), 0, number + 1
                ids, sizes, seen, numbers, counts = state
                x = np.fromiter(map(seen.__getitem__, split(t)), np.int64)
                if frequencies:
                    x, c = np.unique(x, return_counts=True)
                    counts.append(c)
                numbers.append(x)
                ids.append(key)
                sizes.append(len(t.encode()))
                chars += len(t) + 1
        if state[0]:
            yield done(state)

    return docs.select("doc_id", "text").mapInArrow(run, "chunk string, payload binary").repartition("chunk")


def answers(parts: DataFrame, buckets: int, answer: Callable[[list[str]], list]) -> DataFrame:
    """(chunk, places, values): for the words of each chunk in each bucket, their numbers and their answers.

    Each distinct word is answered once: its bucket has it from every chunk."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch["chunk"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                words = _unpack(pickle.loads(payload)[0])
                # A word's bucket comes from its bytes alone, in every process.
                where = np.fromiter((hash_of(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(where, kind="stable")
                bounds = np.searchsorted(where[order], np.arange(buckets + 1))
                used = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
                places = [order[bounds[b] : bounds[b + 1]] for b in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([chunk] * len(used), pa.string()),
                        pa.array([p.astype(np.uint32).tobytes() for p in places], pa.binary()),
                        pa.array([_pack([words[k] for k in p]) for p in places], pa.binary()),
                    ],
                    ["bucket", "chunk", "places", "words"],
                )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, {}
        for batch in batches:
            values = []
            for bucket, words in zip(batch["bucket"].to_pylist(), batch["words"].to_pylist(), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                words = _unpack(words)
                new = [w for w in words if w not in known]
                known.update(zip(new, answer(new), strict=True))
                values.append(_pack([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["places"], pa.array(values, pa.binary())], ["chunk", "places", "values"])

    dealt = parts.mapInArrow(deal, "bucket int, chunk string, places binary, words binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(solve, "chunk string, places binary, values binary")


def hash_of(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def _gathered(table: pa.Table, size: int) -> list:
    """The answers of a chunk in the order of its words."""
    out, found = [None] * size, 0
    for places, values in zip(table["places"].to_pylist(), table["values"].to_pylist(), strict=True):
        got = _unpack(values)
        for k, v in zip(np.frombuffer(places, np.uint32).tolist(), got, strict=True):
            out[k] = v
        found += len(got)
    if found != size:
        raise ValueError(f"{found} answers for {size} words of a chunk")
    return out


def _buckets(docs: DataFrame) -> int:
    return max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _join(docs: DataFrame, path: str, frequencies: bool, answer: Callable[[list[str]], list], finish: Callable, schema: str) -> DataFrame:
    parts = chunks(docs, path, frequencies)
    found = answers(parts, _buckets(docs), answer)

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        outs = []
        for payload in left["payload"].to_pylist():
            dictionary, body = pickle.loads(payload)
            words = _unpack(dictionary)
            outs.append(finish(words, _gathered(right, len(words)), *_unpack(body)))
        return pa.concat_tables(outs)

    return parts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(each, schema)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs: no token ids are kept anywhere."""

    def answer(words: list[str]) -> list[int]:
        return [len(e) for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)]

    kind = dict(docs.dtypes)["doc_id"]
    arrow = _arrow_type(docs)

    def finish(words, pieces, ids, sizes, lengths, numbers, counts):
        sums = np.concatenate([[0], np.cumsum(np.array(pieces, np.int64)[numbers] * counts.astype(np.int64))])
        ends = np.cumsum(lengths)
        tokens = sums[ends] - sums[ends - np.array(lengths)]
        return pa.table([pa.array(ids, arrow), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return _join(docs, path, True, answer, finish, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def piece_bytes(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes that each id stands for. Its size is that of the vocabulary."""
    tok = _tokenizer(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {k: t.content for k, t in tok.get_added_tokens_decoder().items()}
    out = []
    for k in range(tok.get_vocab_size(with_added_tokens=True)):
        piece = special.get(k) or tok.id_to_token(k) or ""
        out.append(bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode())
    return out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for each row of docs."""
    kind, arrow = dict(docs.dtypes)["doc_id"], _arrow_type(docs)

    def finish(words, word_ids, ids, sizes, lengths, numbers, counts):
        at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        out = [[i for k in numbers[a:b].tolist() for i in word_ids[k]] for a, b in zip(at, at[1:], strict=False)]
        return pa.table([pa.array(ids, arrow), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _join(docs, path, False, _encoder(path), finish, f"doc_id {kind}, ids array<int>")


def _encoder(path: str) -> Callable[[list[str]], list]:
    return lambda words: [tuple(e.ids) for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)]


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids), by the id-to-piece table, which is broadcast: its size is the vocabulary's."""
    held = encoded.sparkSession.sparkContext.broadcast(piece_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        for batch in batches:
            texts = [b"".join(map(pieces.__getitem__, ids or ())).decode(errors="replace") for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding joined in one pass, ids and texts as digests.

    Each chunk joins its words' ids to the broadcast id-to-piece table once, then puts both together by position."""
    kind, arrow = dict(docs.dtypes)["doc_id"], _arrow_type(docs)
    held = docs.sparkSession.sparkContext.broadcast(piece_bytes(path))

    def finish(words, word_ids, ids, sizes, lengths, numbers, counts):
        pieces = held.value
        shown = [",".join(map(str, w)) for w in word_ids]
        decoded = [b"".join(map(pieces.__getitem__, w)) for w in word_ids]
        n = np.concatenate([[0], np.cumsum(np.fromiter(map(len, word_ids), np.int64, len(word_ids))[numbers])])
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        tokens, first, second = n[at[1:]] - n[at[:-1]], [], []
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            order = numbers[a:b].tolist()
            first.append(hashlib.sha256(",".join(map(shown.__getitem__, order)).encode()).hexdigest())
            text = b"".join(map(decoded.__getitem__, order)).decode(errors="replace")
            second.append(hashlib.sha256(text.encode()).hexdigest())
        return pa.table([pa.array(ids, arrow), pa.array(tokens, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _join(docs, path, False, _encoder(path), finish, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
