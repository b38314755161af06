"""License scans by canonical digest.

A text is brought to a canonical form: lower case; lines that state a copyright (with a year, a mark or a place for
one) dropped; numbers that begin a line, punctuation and white space reduced to single spaces, so that wrapping does
not matter; equivalent spellings brought to one. The digest of the whole is looked up in a table of known digests.
Notices, which stand as lines of longer texts, are looked up by the digest of their line.

The known texts are the public ones in the folder licenses, each also without what follows its last term, and the
short ones with the usual titles. The table has a few rows for each licence and is broadcast below a stated number
of rows; a larger one is joined by shuffle. Texts are read once: digests and lines as long as a known one are written,
and only lines that match come back to their document.

Defined results: a null or empty text has the digest of the empty text and no licence; of several licences with one
digest the smallest name is given; repeated rows each get their own result row; an empty table gives an empty
result; a text of any length is read whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, row_key

BROADCAST_ROWS = 100_000

# The notices by which texts are marked.
NOTICES = {
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
# The titles that stand above short licences.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "The BSD 3-Clause License", "BSD License"],
    "Zlib": ["zlib License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense"],
}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
# Spellings that licence matching treats as the same, each with the form it is brought to.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "licencing": "licensing", "maximise": "maximize", "merchantibility": "merchantability",
    "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "non infringement": "noninfringement", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
COPYRIGHT = r"^[^\p{L}\p{N}(©]*(copyright\b.*(\(c\)|©|[0-9]{4}|\byyyy\b|<year>)|\(c\)\s*[0-9]{4}|©|all rights reserved)"
NUMBERING = r"^\s*[0-9]{1,2}[.)]\s"
WORDS, PHRASES = ({k: v for k, v in SPELLINGS.items() if (" " in k) == more} for more in (False, True))
ANY_SPELLING = rf"\b({'|'.join(SPELLINGS)})\b"


def _plain_line(line: str) -> str:
    low = line.lower()
    if re.search(COPYRIGHT.replace(r"[^\p{L}\p{N}(©]*", r"(?:(?![(©])[\W_])*"), low):
        return ""
    return re.sub(r"[\W_]+", " ", re.sub(NUMBERING, "", low)).strip()


def canonical(text: str) -> str:
    """The canonical form in plain Python, for the known texts."""
    out = " ".join(x for x in map(_plain_line, text.split("\n")) if x)
    for spelling, form in SPELLINGS.items():
        out = re.sub(rf"\b{spelling}\b", form, out)
    return out


def canonical_line(line: Column) -> Column:
    low = F.lower(line)
    out = F.regexp_replace(F.regexp_replace(low, NUMBERING, ""), r"[^\p{L}\p{N}]+", " ")
    return F.when(F.regexp_like(low, F.lit(COPYRIGHT)), F.lit("")).otherwise(F.trim(out))


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line), lambda x: x != "")


def has_spelling(c: Column) -> Column:
    """Whether a canonical text, of words parted by spaces, has a spelling. Words are looked up in a set."""
    out = F.exists(F.split(c, " "), lambda w: w.isin(list(WORDS)))
    for phrase in PHRASES:
        out = out | F.contains(c, F.lit(phrase))
    return out


def spelled(c: Column) -> Column:
    """A canonical text with its spellings brought to one form: words by a map, then the few phrases by patterns."""
    forms = F.create_map(*(F.lit(x) for pair in WORDS.items() for x in pair))
    out = F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(forms, w), w)), " ")
    for phrase, form in PHRASES.items():
        out = F.regexp_replace(out, rf"\b{phrase}\b", form)
    return F.when(has_spelling(c), out).otherwise(c)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of the public texts in all their known forms, and of the notices."""
    out = list(NOTICES.items())
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        bodies = [text, text[: text.rindex(END_OF_TERMS) + len(END_OF_TERMS)]] if END_OF_TERMS in text else [text]
        bodies += [b.split(END_OF_TERMS)[0] for b in bodies[1:]]
        out += [(path.stem, b) for b in bodies] + [(path.stem, f"{t}\n\n{text}") for t in TITLES.get(path.stem, [])]
    return out


def known_rows(known: list[tuple[str, str]] | None = None) -> list[tuple[str, str, int]]:
    """(digest, license, length of the canonical form), one row for each digest."""
    rows: dict[str, tuple[str, int]] = {}
    for name, text in known_texts() if known is None else known:
        c = canonical(text)
        k = hashlib.sha256(c.encode()).hexdigest()
        rows[k] = min(rows.get(k, (name, len(c))), (name, len(c)))
    return [(k, *v) for k, v in sorted(rows.items())]


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(known_rows(known), "digest string, license string, n_chars int")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_digest, license, notices) for each row: the licence that the whole text is, and those that lines of it name."""
    lengths = [r["n_chars"] for r in known.select("n_chars").distinct().limit(1001).collect()]
    known = known.select("digest", "license")
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    # A line of another length than any known text cannot match; with very many lengths every line is looked up.
    fits = lambda x: F.length(x).isin(lengths) if len(lengths) <= 1000 else F.lit(True)
    lines = docs.select(row_key().alias("row"), "doc_id", F.inline(F.array(F.struct(canonical_lines(F.col("text")).alias("lines")))))
    # Spellings may change a length, so a line with one is kept too.
    some = F.array_distinct(F.filter("lines", lambda x: fits(x) | has_spelling(x)))
    texts = materialise(lines.select("row", "doc_id", digest(spelled(F.array_join("lines", " "))).alias("text_digest"), some.alias("lines")))
    named = (
        texts.select("row", F.explode("lines").alias("line"))
        .select("row", digest(spelled(F.col("line"))).alias("digest"))
        .join(known, "digest")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("license")).alias("notices"))
    )
    found = texts.drop("lines").join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(named, "row", "left")
    return found.select("doc_id", "text_digest", "license", F.array_join(F.coalesce("notices", F.array().cast("array<string>")), ",").alias("notices"))
