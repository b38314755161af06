"""Quality rules: per-document counts, and line frequency across the documents of a host.

A line is boilerplate where many documents of its host hold it. Exact copies of a text must not count each other's
lines as boilerplate, so documents are told apart by the digest of their text, both those of a line and those of the
host. Lines above the limit are removed, and a document that keeps too small a share of its words is rejected.

All is built from DataFrame functions. Different (host, line, digest) are found first, spread by all three, and are
then pre-aggregated by (host, line), so a line found in every document of a hot host arrives as a row of each task.

Defined results: a null text has no words and no lines; a null host is a host of its own; repeated rows each get
their own result row; an empty table gives an empty result; columns other than doc_id, text and the host are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, fenced, free_name, materialise, row_key, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Repeated window hashes of a document that are looked for one by one.
FEW = 32
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A line is boilerplate from this many different documents of a host, and this share of the host's documents.
LINE_DOCS = 20
LINE_SHARE = 0.05
#: A document is depleted when fewer than this share of its words remain.
KEEP_SHARE = 1 / 3


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Repeated 3-word windows are found from the document's own window hashes (64 bits of the three words' hashes, which
    two of one document's windows share by chance once in 10^14 documents): sorted, equal neighbours are repeats. A few
    repeated hashes are looked for in the windows in order; with many, hashes and places are sorted together. The
    words that the repeated windows cover are summed over the places in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = fenced(docs, __words=words_of(F.col("text")), __lines=lines)
    d = fenced(d, __each=F.transform("__words", lambda x: F.xxhash64(x)), n_words=F.size("__words").cast("long"))
    e, starts = F.col("__each"), F.sequence(F.lit(0), F.size("__each") - 3)
    d = fenced(d, __windows=F.when(F.col("n_words") >= 4, F.transform(starts, lambda i: F.xxhash64(e[i], e[i + 1], e[i + 2]))))
    h = F.col("__windows")
    d = fenced(d, __sorted=F.sort_array(h))
    s = F.col("__sorted")
    d = fenced(d, __twice=F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == s[F.greatest(k - 1, F.lit(0))]))))
    few = F.filter(starts, lambda i: F.array_contains("__twice", h[i]))
    d = fenced(d, __pairs=F.when(F.size("__twice") > FEW, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    p, last = F.col("__pairs"), F.size("__pairs") - 1
    same = lambda x, k: x["h"] == p[k]["h"]
    many = F.filter(p, lambda x, k: ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | ((k < last) & same(x, F.least(k + 1, last))))
    places = F.when(F.size("__twice") > FEW, F.sort_array(F.transform(many, lambda x: x["i"]))).when(F.size("__twice") > 0, few)
    d = fenced(d, __places=places)
    covered = F.aggregate(
        F.col("__places"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
        lambda a: a["n"],
    )
    zero = F.lit(0).cast("long")
    d = fenced(
        d,
        word_chars=F.length(F.array_join("__words", "")).cast("long"),
        n_symbols=F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        n_repeat_words=F.coalesce(covered, zero),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("__words", "__lines", "__each", "__windows", "__sorted", "__twice", "__pairs", "__places")


def text_digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def line_words(docs: DataFrame, host: str = "source") -> DataFrame:
    """(row, pos, host, line, digest, words): a row for each line with a word; line is the md5 of its normal form, digest that of the text."""
    lines = F.transform(
        F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))
    )
    named = F.transform(
        F.filter(lines, lambda x: x != ""),
        lambda x: F.struct(F.unhex(F.md5(x)).alias("line"), F.size(words_of(x)).alias("words")),
    )
    d = docs.select(row_key().alias("row"), F.col(host).alias("host"), text_digest().alias("digest"), named.alias("ls"))
    d = d.select("row", "host", "digest", F.posexplode("ls").alias("pos", "l"))
    return d.select("row", "pos", "host", F.col("l.line").alias("line"), "digest", F.col("l.words").alias("words"))



def boilerplate(lines: DataFrame, docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, line): the lines above the limits of their host."""
    hosts = docs.select(F.col(host).alias("h"), text_digest()).distinct().groupBy("h").agg(F.count("*").alias("n_host"))
    found = (
        lines.select("host", "line", "digest")
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= line_docs)
    )
    return (
        found.join(hosts, F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("n_docs") >= line_share * F.col("n_host"))
        .select("host", "line")
    )


def quality(docs: DataFrame, host: str = "source", keep_share: float = KEEP_SHARE) -> DataFrame:
    """(row, doc_id, the counts, base_failed, n_removed_words, kept) for each row of docs."""
    lines = materialise(line_words(docs, host))
    bad = boilerplate(lines, docs, host).withColumnsRenamed({"host": "h", "line": "l"})
    hit = lines.join(bad, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    # Repeated rows share a key, so a line counts once for its key and place.
    removed = hit.select("row", "pos", "words").distinct().groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    base = base_counts(docs.select("doc_id", "text", row_key().alias("row"))).drop("text")
    d = base.join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed_words")
    return d.withColumn("kept", ~F.col("base_failed") & (left >= keep_share * F.col("n_words")))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs."""
    row = free_name(docs, "row")
    good = quality(docs.select("doc_id", "text", F.col(host).alias("host")), "host").where("kept").select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_key()).join(good, row, "left_semi").drop(row)
