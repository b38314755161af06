"""Matching of observed payments to reference records, and their field comparison."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sequence_similar
from ..sources.scratch import stored
from .messages import bound

GENERIC = "GENERIC_MOMO"
CRITICAL = ["amount", "currency", "receiver_phone", "transaction_status"]
NAME_RATIO = 0.90
MINUTES = 30


def committed(refs: DataFrame, batches: DataFrame) -> DataFrame:
    return refs.join(batches.where(F.col("status") == "COMMITTED").select("batch_id"), "batch_id", "left_semi")


def candidates(obs: DataFrame, refs: DataFrame) -> DataFrame:
    """(observation_id, ref_id, exact): by provider and reference, or by reference alone where the provider is missing
    or generic. One equi-join on the reference serves both."""
    generic = F.col("o.provider_code").isNull() | (F.col("o.provider_code") == GENERIC)
    r = refs.select("ref_id", "provider_code", "transaction_reference").alias("r")
    o = obs.select("observation_id", "provider_code", "transaction_reference").alias("o")
    hit = o.join(r, F.col("o.transaction_reference") == F.col("r.transaction_reference"))
    hit = hit.where(generic | (F.col("o.provider_code") == F.col("r.provider_code")))
    return hit.select("observation_id", "ref_id", (~generic).alias("exact"))


def resolve(obs: DataFrame, refs: DataFrame) -> DataFrame:
    """(observation_id, n_candidates, ref_id, method): ref_id only where one candidate is left."""
    c = candidates(obs, refs).groupBy("observation_id").agg(F.count("*").alias("n"), F.min("ref_id").alias("only"), F.bool_or("exact").alias("exact"))
    d = obs.select("observation_id", "transaction_reference").join(c, "observation_id", "left")
    n = F.coalesce("n", F.lit(0))
    method = (
        F.when(F.col("transaction_reference").isNull(), "NO_CANONICAL_REFERENCE")
        .when(n == 0, "NO_REFERENCE_RECORD")
        .when(n > 1, "AMBIGUOUS_PROVIDER_REFERENCE")
        .when(F.col("exact"), "EXACT_PROVIDER_REFERENCE")
        .otherwise("UNIQUE_REFERENCE_FALLBACK")
    )
    return d.select("observation_id", n.alias("n_candidates"), F.when(n == 1, F.col("only")).alias("ref_id"), method.alias("method"))


def compare_fields(obs: DataFrame, refs: DataFrame, resolved: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Long form (observation_id, field, status) of resolved observations. Names by the Ratcliff/Obershelp ratio."""
    m = resolved.where(F.col("ref_id").isNotNull()).select("observation_id", "ref_id").join(obs.alias("o"), "observation_id").join(refs.alias("r"), "ref_id")

    def pair(c: str) -> tuple[Column, Column]:
        return F.col(f"o.{c}"), F.col(f"r.{c}")

    def judged(ok: Column, *need: Column) -> Column:
        missing = F.lit(False)
        for c in need:
            missing = missing | c.isNull()
        return F.when(missing, "NOT_AVAILABLE").when(ok, "MATCH").otherwise("MISMATCH")

    def name(c: str) -> Column:
        a, b = (F.nullif(F.lower(x), F.lit("")) for x in pair(c))
        return judged(sequence_similar(a, b, NAME_RATIO), a, b)

    equal = lambda c: judged(pair(c)[0] == pair(c)[1], *pair(c))
    a, b = pair("amount")
    t, u = (F.unix_timestamp(x.cast("timestamp")) for x in pair("occurred_at"))
    fields = {
        "amount": F.when(F.abs(a - b) <= tolerance, "MATCH").otherwise("MISMATCH"),
        "currency": F.when(pair("currency")[0] == pair("currency")[1], "MATCH").otherwise("MISMATCH"),
        "sender_phone": equal("sender_phone"),
        "receiver_phone": equal("receiver_phone"),
        "sender_name": name("sender_name"),
        "receiver_name": name("receiver_name"),
        "occurred_at": judged(F.abs(t - u) <= 60 * MINUTES, t, u),
        "transaction_status": equal("transaction_status"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("status")) for k, v in fields.items())))
    return m.select("observation_id", rows.alias("x")).select("observation_id", "x.field", "x.status")


def verification_status(comparisons: DataFrame, critical: list[str] = CRITICAL) -> DataFrame:
    bad = lambda s: F.bool_or(F.col("field").isin(critical) & (F.col("status") == s))
    return comparisons.groupBy("observation_id").agg(
        F.when(bad("MISMATCH"), "MISMATCH").when(bad("NOT_AVAILABLE"), "UNVERIFIED").otherwise("VERIFIED").alias("verification_status"),
        F.count_if(F.col("status") == "MATCH").alias("matched"),
        F.count_if(F.col("status") == "MISMATCH").alias("mismatched"),
    )


def reuse_warnings(obs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(observation_id, warnings): reference used by an earlier observation; receipt hash on another observation."""
    used = resolved.where(F.col("ref_id").isNotNull()).groupBy("ref_id").agg(F.min("observation_id").alias("first"))
    a = resolved.join(used, "ref_id").where(F.col("observation_id") > F.col("first")).select("observation_id", F.lit("REFERENCE_ALREADY_USED").alias("w"))
    same = obs.groupBy("receipt_sha").agg(F.min("observation_id").alias("lo"), F.max("observation_id").alias("hi")).where("lo <> hi")
    b = obs.join(same, "receipt_sha").select("observation_id", F.lit("RECEIPT_REUSED").alias("w"))
    return a.unionByName(b).groupBy("observation_id").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("warnings"))


def in_file_duplicates(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Second and later rows of a key whose parts are all present."""
    have = rows
    for c in key[:2]:
        have = have.where(F.col(c).isNotNull())
    return have.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("n > 1").drop("n")


def import_conflicts(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    return new.where(F.col(key[-1]).isNotNull()).join(old, key, "left_semi")


def masked(c: Column) -> Column:
    return F.when(F.length(c) > 7, F.concat(F.substring(c, 1, 4), F.lit("..."), F.right(c, F.lit(2)))).otherwise(c)


def canonical_phone(c: Column) -> Column:
    """+233 form of a local or international number; null where it is neither."""
    return phone_of(F.regexp_replace(c, "[^0-9]", ""))


def phone_of(d: Column) -> Column:
    """canonical_phone of a number's digits."""
    local = F.when(d.rlike("^0[0-9]{9}$"), F.substring(d, 2, 9)).when(d.rlike("^[25][0-9]{8}$"), d)
    return F.when(d.rlike("^233[0-9]{9}$"), F.concat(F.lit("+"), d)).otherwise(F.concat(F.lit("+233"), local))


# The forms of a time, day first or year first, and the ISO form with its parts (year, month, day, hour, minute, second,
# fraction, zone).
DAY_FIRST = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}) (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
YEAR_FIRST = r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?([Zz]|[+-]\d{2}(?::?\d{2})?)?)?$"


def occurred_at(text: Column) -> Column:
    """struct(at, zoned) of a time in one of the six forms, or else in ISO form: at is null where it is none; a time without
    a zone is one of UTC. text has single spaces. Week dates are not read."""
    return bound(time_parts(text), time_of)


def time_parts(text: Column) -> Column:
    """The eight parts of a time, empty where one is missing; null where text has no form of a time.

    A text that has one of the six forms and is no time is none in ISO form either."""
    cut = F.lit(None).cast("string")
    for p, order in {ISO: "$1,$2,$3,$4,$5,$6,$7,$8", DAY_FIRST: "$4,$3,$1,$5,$6,$7,,", YEAR_FIRST: "$1,$2,$3,$4,$5,$6,,"}.items():
        cut = F.when(text.rlike(p), F.regexp_replace(text, p.removesuffix("$") + r"\s*$", order)).otherwise(cut)
    return F.split(cut, ",")


def time_of(parts: Column) -> Column:
    """occurred_at of the parts. Only those that can be a time are made into one, as a failure is dear."""
    part = lambda k: F.coalesce(F.when(parts[k] != "", parts[k].cast("int")), F.lit(0))
    y, mo, d, h, mi, s = (part(k) for k in range(6))
    seconds = F.concat(s.cast("string"), F.lit("."), F.rpad(parts[6], 6, "0")).cast("decimal(16,6)")
    could = mo.between(1, 12) & d.between(1, 31) & (h < 24) & (mi < 60) & (s < 60)
    at = F.when(could, F.try_make_timestamp(y, mo, d, h, mi, seconds, F.lit("UTC")))
    zone = parts[7]
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.coalesce(F.regexp_extract(zone, r"^.\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    shift = F.when(F.upper(zone).isin("", "Z"), 0).when((hours < 24) & (minutes < 60), F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (hours * 60 + minutes))
    moved = F.timestamp_micros(F.unix_micros(at) - shift.cast("long") * 60_000_000)
    return F.struct(moved.alias("at"), F.coalesce(zone != "", F.lit(False)).alias("zoned"))


def near_duplicates(hashes: DataFrame, d: int, bands: int | None = None) -> DataFrame:
    """(a, b, distance): pairs a < b of 64-bit hashes (id, hi, lo) within d bits, exact copies left out.

    Different hashes are nodes, posted under each choice of bands - d of the bands: a pair within d bits agrees on one
    choice at least, and counts under the first of them only. With four bands more than d, which is the default, a list is
    of about 256 / (d + 4) bits, so few hashes meet that are not near. Pairs are of class representatives (the smallest id
    of a hash). The join is by sorted shuffles: the planner's sizes do not know that each hash has many postings."""
    nodes = hashes.groupBy("hi", "lo").agg(F.min("id").alias("id"))
    v, m = F.shiftleft("hi", 32).bitwiseOR(F.col("lo")), bands or d + 4
    edges = [round(64 * k / m) for k in range(m + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chosen = list(itertools.combinations(parts, m - d))
    # Bands before a choice's last that are none of it: where two hashes agree on one of them, they meet in an earlier list.
    others = F.array(*(F.array(*(F.lit(signed(x)) for x in parts[: parts.index(c[-1])] if x not in c)).cast("array<bigint>") for c in chosen))
    lists = F.transform(F.array(*(F.lit(signed(sum(c))) for c in chosen)), lambda x, k: F.struct(k.cast("smallint").alias("list"), F.col("v").bitwiseAND(x).alias("bits")))
    posted = nodes.select("id", v.alias("v")).select("id", "v", F.explode(lists).alias("p")).select("id", "v", "p.list", "p.bits")
    left, right = posted.alias("l"), posted.hint("merge").alias("r")
    x = F.col("l.v").bitwiseXOR(F.col("r.v"))
    dist = F.bit_count(x)
    pairs = left.join(right, ["list", "bits"]).where((F.col("l.id") < F.col("r.id")) & (dist <= d))
    first = F.forall(F.get(others, F.col("list")), lambda band: x.bitwiseAND(band) != 0)
    return pairs.where(first).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), dist.cast("int").alias("distance"))


#: Codes of a list that one task holds; a longer list is met block by block. Codes compared at once, and lists short enough to be shifted.
BLOCK, TILE, SHORT = 1 << 14, 1 << 10, 64


def _choices(d: int, n: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """The masks of d + e bands, and the choices of e of them under which codes are listed: two codes within d bits agree on
    one choice at least. e is the one of least work, by the number of codes: more bands make more, and shorter, lists."""
    lists = lambda e: math.comb(d + e, e)
    e = min(range(1, 5), key=lambda e: lists(e) * n * (50 + n / 2 ** (64 * e / (d + e))))
    edges = [round(64 * k / (d + e)) for k in range(d + e + 1)]
    return [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)], list(itertools.combinations(range(d + e), e))


class _Near:
    """Counts of near codes within lists: for each row its near codes' copies, least distance and first id."""

    def __init__(self, d: int, bands: list[int], choices: list[tuple[int, ...]]):
        self.d = d
        self.bands = [np.uint64(b) for b in bands]
        first = np.full(1 << len(bands), len(choices), np.int64)
        for k in range(len(choices) - 1, -1, -1):
            mask = sum(1 << b for b in choices[k])
            first[(np.arange(len(first)) & mask) == mask] = k
        self.first, self.choices = first, choices

    def own(self, x: np.ndarray, number: int) -> np.ndarray:
        """Whether a pair of codes that differ in x meets first in the list of this number, so that it counts there only."""
        if len(self.choices) == len(self.bands):  # one band a choice: none of those before agrees
            out = np.ones(x.shape, bool)
            for b in self.bands[:number]:
                out &= (x & b) != 0
            return out
        agree = np.zeros(x.shape, np.int64)
        for k, b in enumerate(self.bands):
            agree |= ((x & b) == 0).astype(np.int64) << k
        return self.first[agree] == number

    def short(self, run: np.ndarray, number: np.ndarray, side: np.ndarray, cross: np.ndarray, v: np.ndarray, ids: np.ndarray, n: np.ndarray, out: tuple) -> None:
        """Lists of a few codes, all at once: neighbours 1, 2, ... places apart are compared."""
        at, far = np.arange(len(run)), 1
        while True:
            at = at[at < len(run) - far]
            at = at[run[at] == run[at + far]]
            if not len(at):
                return
            b = at + far
            x = v[at] ^ v[b]
            dist = np.bitwise_count(x)
            ok = (dist <= self.d) & (~cross[at] | (side[at] != side[b]))
            for k in np.unique(number[at[ok]]).tolist():
                some = np.flatnonzero(ok & (number[at] == k))
                ok[some] = self.own(x[some], k)
            for p, q in ((at[ok], b[ok]), (b[ok], at[ok])):
                np.add.at(out[0], p, n[q])
                np.minimum.at(out[1], p, dist[ok])
                np.minimum.at(out[2], p, ids[q])
            far += 1

    def long(self, number: int, left: np.ndarray, right: np.ndarray | None, v: np.ndarray, ids: np.ndarray, n: np.ndarray, out: tuple) -> None:
        """A long list, or two blocks of one (rows left and right, in the order of their ids), tile by tile."""
        same = right is None
        right = left if same else right
        plain = bool((n[left] == 1).all() and (n[right] == 1).all())
        tiles = lambda r: [r[k : k + TILE] for k in range(0, len(r), TILE)]
        for i, p in enumerate(tiles(left)):
            for q in tiles(right)[i if same else 0 :]:
                x = v[p][:, None] ^ v[q]
                dist = np.bitwise_count(x)
                near = (dist <= self.d) & (dist > 0)
                if not near.any():
                    continue
                near &= self.own(x, number)
                dist[~near] = 255
                for rows, cols, m, least in ((p, q, near, dist), (q, p, near.T, dist.T))[: 1 if same and q is p or same and q[0] == p[0] else 2]:
                    out[0][rows] += np.count_nonzero(m, axis=1) if plain else (m.astype(np.float64) @ n[cols]).astype(np.int64)
                    out[1][rows] = np.minimum(out[1][rows], least.min(axis=1))
                    first = ids[cols[m.argmax(axis=1)]]
                    some = m.any(axis=1)
                    out[2][rows[some]] = np.minimum(out[2][rows[some]], first[some])


def near_counts(hashes: DataFrame, d: int) -> DataFrame:
    """(id, copies, near_count, min_distance, first_near) for each row of 64-bit hashes (id, hi, lo).

    copies: other rows of the same hash. near_count: rows of other hashes within d bits; min_distance: the least of their
    distances; first_near: the smallest id that has one of their hashes first; null and 0 where there are none.

    Different hashes are codes with their number of copies. They are listed by choices of their bands, and only the codes
    of one list are compared; a pair counts in the first list where it meets. Nothing is made of pairs but these three
    figures by code, so the result grows with the rows however dense a neighbourhood is. A list beyond BLOCK codes is
    cut into blocks by hash, and each two blocks of it meet in a group of their own. Codes of one dense ball are still
    compared each with each (about seven times 10 ns a pair), in tiles.

    The codes are counted while the plan is built, to choose the bands."""
    v = F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("v")
    nodes = stored(hashes.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.count("*").alias("n")).select("hi", "lo", v, "first", "n"))
    bands, choices = _choices(d, max(2, nodes.count()))
    masks = [sum(bands[k] for k in c) for c in choices]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    lists = F.transform(F.array(*map(F.lit, signed)), lambda x, k: F.struct(k.cast("int").alias("list"), F.col("v").bitwiseAND(x).alias("bits")))
    posted = nodes.select("v", "first", "n", F.explode(lists).alias("p")).select("p.list", "p.bits", "v", "first", "n")
    hot = posted.groupBy("list", "bits").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    d_ = posted.join(hot, ["list", "bits"], "left")
    d_ = d_.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    d_ = d_.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d_ = d_.select("list", "bits", F.least("side", "x").alias("i"), F.greatest("side", "x").alias("j"), "side", "v", "first", "n")
    key = ["list", "bits", "i", "j"]
    work = _Near(d, bands, choices)

    def solved(t: pa.Table) -> pa.RecordBatch:
        c = {k: t[k].to_numpy() for k in t.column_names}
        code, ids, n, side = c["v"].view(np.uint64), c["first"], c["n"], c["side"]
        turn = np.ones(len(code), bool)
        turn[1:] = np.any([c[k][1:] != c[k][:-1] for k in key], axis=0)
        start = np.flatnonzero(turn)
        size = np.diff(np.append(start, len(code)))
        out = np.zeros(len(code), np.int64), np.full(len(code), 255, np.uint8), np.full(len(code), np.iinfo(np.int64).max)
        few = np.repeat((size > 1) & (size <= SHORT), size)
        if few.any():
            own = tuple(x[few] for x in out)
            run = np.repeat(np.arange(len(size)), size)[few]
            work.short(run, c["list"][few], side[few], (c["i"] != c["j"])[few], code[few], ids[few], n[few], own)
            for x, y in zip(out, own, strict=True):
                x[few] = y
        for s, k in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            rows = s + np.argsort(ids[s : s + k], kind="stable")
            i, j, number = int(c["i"][s]), int(c["j"][s]), int(c["list"][s])
            left, right = (rows, None) if i == j else (rows[side[rows] == i], rows[side[rows] == j])
            if len(left) and (right is None or len(right)):
                work.long(number, left, right, code, ids, n, out)
        found = out[0] > 0
        cols = [pa.array(c["v"][found]), pa.array(out[0][found]), pa.array(out[1][found].astype(np.int32)), pa.array(out[2][found])]
        return pa.RecordBatch.from_arrays(cols, ["v", "near", "least", "first"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole lists, with what a batch leaves of its last one carried to the next."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = np.ones(t.num_rows, bool)
            for k in key:
                x = t[k].to_numpy()
                last &= x == x[-1]
            cut = t.num_rows - int(last.sum())
            if cut:
                yield solved(t.slice(0, cut).combine_chunks())
            held = t.slice(cut)
        if held is not None:
            yield solved(held.combine_chunks())

    dealt = d_.repartition(*key).sortWithinPartitions(*key)
    found = dealt.mapInArrow(each, "v bigint, near bigint, least int, first bigint")
    found = found.groupBy("v").agg(F.sum("near").alias("near_count"), F.min("least").alias("min_distance"), F.min("first").alias("first_near"))
    out = nodes.join(found, "v", "left").select("hi", "lo", (F.col("n") - 1).alias("copies"), F.coalesce("near_count", F.lit(0)).alias("near_count"), "min_distance", "first_near")
    return hashes.join(out, ["hi", "lo"]).select("id", "copies", "near_count", "min_distance", "first_near")


def import_errors(raw: DataFrame, canonical: DataFrame, key: str, order: str) -> DataFrame:
    """(key, field, code, message): one row for each field of a reference row that is missing or not of its form, and for each
    row that repeats an earlier one's provider, reference and source id. raw has the texts, canonical what became of them."""
    required = {"provider_code": "INVALID_PROVIDER", "transaction_reference": "INVALID_REFERENCE", "amount": "INVALID_DECIMAL", "currency": "INVALID_CURRENCY"}
    optional = {
        "sender_phone": ("INVALID_GHANA_PHONE", "Use a Ghanaian phone format."), "receiver_phone": ("INVALID_GHANA_PHONE", "Use a Ghanaian phone format."),
        "occurred_at": ("INVALID_TIMESTAMP", "Use an ISO or supported Ghana date/time format."),
        "transaction_status": ("INVALID_TRANSACTION_STATUS", "Transaction status must contain 1 to 50 characters."),
    }
    given = {c: F.coalesce(F.col(f"raw_{c}"), F.lit("")) != "" for c in optional}
    rules = [(c, F.col(c).isNull(), code, f"Invalid {c}.") for c, code in required.items()]
    rules += [(c, given[c] & F.col(c).isNull(), *said) for c, said in optional.items()]
    rules.append(("source_system_id", F.coalesce(F.length("source_system_id") > 150, F.lit(False)), "SOURCE_SYSTEM_ID_TOO_LONG", "Source-system identifiers must be 150 characters or fewer."))
    d = canonical.join(raw.select(key, *(F.col(c).alias(f"raw_{c}") for c in optional)), key)
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(c).alias("field"), F.lit(code).alias("code"), F.lit(text).alias("message"))) for c, bad, code, text in rules)))
    errors = d.select(key, F.explode(found).alias("e")).select(key, "e.field", "e.code", "e.message")
    repeated = in_file_duplicates(canonical, ["provider_code", "transaction_reference", "source_system_id"], order)
    said = F.lit("This provider/reference/source combination is repeated in the file.")
    return errors.unionByName(repeated.select(key, F.lit("transaction_reference").alias("field"), F.lit("DUPLICATE_ROW").alias("code"), said.alias("message")))


def import_batch_summary(refs: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: total, invalid (different rows with an error), valid, status."""
    bad = errors.select("ref_id").distinct().agg(F.count("*").alias("invalid"))
    n = refs.agg(F.count("*").alias("total")).crossJoin(F.broadcast(bad))
    return n.select("total", "invalid", (F.col("total") - F.col("invalid")).alias("valid"), F.when(F.col("invalid") == 0, "VALIDATED").otherwise("VALIDATED_WITH_ERRORS").alias("status"))
