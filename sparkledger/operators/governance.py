"""Splits, group leakage, manifests, withdrawals, workflow states, history reads and set audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import exact_percentile, running
from .transactions import codes


def largest_remainder(n: int, ratios: tuple[float, ...]) -> list[int]:
    """Shares of n in whole numbers; what is left after rounding down goes to the largest remainders, the earlier first."""
    raw = [n * r for r in ratios]
    out = [int(x) for x in raw]
    for k in sorted(range(len(ratios)), key=lambda k: (out[k] - raw[k], k))[: n - sum(out)]:
        out[k] += 1
    return out


#: Train, validation and test shares of controlled groups, and of the others.
CONTROLLED, OTHERS = (0.70, 0.15, 0.15), (0.80, 0.20, 0.0)


def group_hash_split(df: DataFrame, group: str, seed: str, controlled: Column | None = None) -> DataFrame:
    """(group_id, controlled, split): groups in hash order, those of each provenance cut at the quotas of its shares.

    controlled says which rows are of the controlled provenance (a group is if any row is); all are, if it is not given."""
    c = F.lit(True) if controlled is None else F.coalesce(controlled, F.lit(False))
    g = df.groupBy(F.col(group).alias("group_id")).agg(F.max(c).alias("controlled"))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group_id")), 256)
    g = g.withColumn("__h", h)
    sizes = {r["controlled"]: r["n"] for r in g.groupBy("controlled").agg(F.count("*").alias("n")).collect()}
    k = running(g, [F.col("__h")], {"k": F.lit(1)}, ["controlled"])
    split = F.lit("train")
    for kind, n in sizes.items():
        train, validation, _ = largest_remainder(n, CONTROLLED if kind else OTHERS)
        cut = F.when(F.col("k") <= train, "train").when(F.col("k") <= train + validation, "validation").otherwise("test")
        split = F.when(F.col("controlled") == kind, cut).otherwise(split)
    return k.select("group_id", "controlled", split.alias("split"))


def group_leakage(df: DataFrame) -> DataFrame:
    return df.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def count_cube(df: DataFrame) -> DataFrame:
    return df.cube("split", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def duplicate_label_conflicts(df: DataFrame) -> DataFrame:
    g = df.groupBy("sha").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("n > 1")
    return g.select("sha", "n", F.when(F.col("a") == F.col("b"), "duplicate_sha256").otherwise("conflicting_duplicate_labels").alias("code"))


def class_coverage(df: DataFrame, splits: list[str], labels: list[int]) -> DataFrame:
    """The (split, label) pairs that no row has; the required pairs are a small literal table."""
    need = df.sparkSession.createDataFrame([(s, x) for s in splits for x in labels], "split string, label int")
    return need.join(df.select("split", "label").distinct(), ["split", "label"], "left_anti")


def parent_integrity(df: DataFrame) -> DataFrame:
    p = df.select(F.col("sample_id").alias("parent_id"), F.col("group_id").alias("pg"), F.col("split").alias("ps"))
    d = df.where(F.col("parent_id").isNotNull()).join(p, "parent_id", "left")
    code = F.when(F.col("pg").isNull(), "PARENT_MISSING").when((F.col("pg") != F.col("group_id")) | (F.col("ps") != F.col("split")), "PARENT_CROSSES_GROUP_OR_SPLIT")
    return d.select("sample_id", code.alias("code")).where(F.col("code").isNotNull())


def exclude_withdrawn(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return df.join(ledger.select(key), key, "left_anti")


def propagate_withdrawal(df: DataFrame, ledger: DataFrame, key: str, derived: list[str]) -> DataFrame:
    d = df.join(ledger.select(key, F.lit(True).alias("__w")).distinct(), key, "left")
    gone = F.coalesce("__w", F.lit(False))
    return d.withColumns({c: F.when(~gone, F.col(c)) for c in derived} | {"state": F.when(gone, "WITHDRAWN").otherwise("ACTIVE")}).drop("__w")


def exact_duplicate_pairs(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(id, original): each later copy with its first; the first comes from a combined aggregate, not a window."""
    first = df.groupBy(key).agg(F.min(seq).alias("original"), F.count("*").alias("n")).where("n > 1")
    return df.join(first, key).where(F.col(seq) > F.col("original")).select(F.col(seq).alias("id"), "original")


def paired_audit(a: DataFrame, b: DataFrame, key: str, category: str, size: str, stem: bool = False) -> DataFrame:
    """By category: keys of a and of b that are paired, missing in b, orphans of b, and pairs of different sizes.

    Keys are lower case, without their suffix if stem; of several rows of a key the largest size counts. The category of a
    pair is a's."""
    name = F.lower(key)
    name = F.regexp_replace(name, r"\.[^./]*$", "") if stem else name
    side = lambda d, m: d.groupBy(name.alias("k")).agg(F.min(category).alias(f"c{m}"), F.max(size).alias(f"s{m}"), F.lit(True).alias(m))
    j = side(a, "x").join(side(b, "y"), "k", "full_outer").withColumn("category", F.coalesce("cx", "cy"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.groupBy("category").agg(
        F.count_if(both).alias("paired"), F.count_if(F.col("y").isNull()).alias("missing"), F.count_if(F.col("x").isNull()).alias("orphan"), F.count_if(both & ~F.col("sx").eqNullSafe(F.col("sy"))).alias("size_mismatches")
    )


def paired_drift(audit: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(category, reason): the categories whose number of pairs is not the expected one."""
    want = audit.sparkSession.createDataFrame(sorted(expected.items()), "category string, want long")
    d = audit.select("category", "paired").join(F.broadcast(want), "category", "full_outer")
    reason = F.when(F.col("want").isNull(), "UNEXPECTED_CATEGORY").when(F.col("paired").isNull(), "CATEGORY_MISSING").when(F.col("paired") != F.col("want"), "COUNT_DRIFT")
    return d.select("category", reason.alias("reason")).where(F.col("reason").isNotNull())


def state_transition_audit(events: DataFrame, allowed: list[tuple[str, str]], approved: list[str]) -> DataFrame:
    """(record_id, seq, code): from differs from the previous to, the pair is not allowed, or an approval has nothing before it."""
    prev = F.lag("to_state").over(Window.partitionBy("record_id").orderBy("seq"))
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    d = events.withColumn("prev", prev)
    broken = ~F.col("from_state").eqNullSafe(F.col("prev"))
    bad = F.col("from_state").isNotNull() & ~F.array_contains(pairs, F.concat_ws(">", "from_state", "to_state"))
    bare = F.col("to_state").isin(approved) & F.col("prev").isNull()
    return d.select("record_id", "seq", F.explode(codes(APPROVED_WITHOUT_HISTORY=bare, BROKEN_CHAIN=broken, PAIR_NOT_ALLOWED=bad)).alias("code"))


def first_n_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    keep = df.select(group).distinct().orderBy(group).limit(n)
    return df.join(F.broadcast(keep), group, "left_semi")


def page(df: DataFrame, number: int, size: int, order: list) -> DataFrame:
    total = df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def history_filter(runs: DataFrame, provider: str | None = None, status: str | None = None, verification: str | None = None, band: str | None = None) -> DataFrame:
    out = runs
    for c, v in (("provider_code", provider), ("status", status), ("verification_status", verification)):
        out = out if v is None else out.where(F.col(c) == v)
    if band == "inconclusive":
        return out.where(F.col("risk_level").isNull() & (F.col("status") == "PARTIAL"))
    return out if band is None else out.where(F.col("risk_level") == band.upper())


def search_filter(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return df.where(hit)


def operations_dashboard(runs: DataFrame, cases: DataFrame, since: str | None = None, until: str | None = None, provider: str | None = None) -> DataFrame:
    """By provider: runs by risk, status and verification, mean and exact 95th percentile of the time, cases by state.

    runs may be limited to those completed in [since, until) and to a provider; cases has run_id and state."""
    d = runs
    for keep, at in ((lambda c, t: c >= t, since), (lambda c, t: c < t, until)):
        d = d if at is None else d.where(keep(F.col("completed_at"), F.lit(at).cast("timestamp")))
    d = d if provider is None else d.where(F.col("provider_code") == provider)
    said = lambda c, v: F.count_if(F.col(c) == v)
    g = d.groupBy("provider_code").agg(
        F.count("*").alias("n_runs"), *(said("risk_level", x).alias(x.lower()) for x in ("LOW", "MEDIUM", "HIGH")), F.count_if(F.col("risk_level").isNull()).alias("inconclusive"),
        said("status", "PARTIAL").alias("partial"), *(said("verification_status", x).alias(x.lower()) for x in ("VERIFIED", "MISMATCH", "UNVERIFIED")), F.round(F.avg("duration_ms"), 4).alias("mean_ms"),
    )
    late = exact_percentile(d, "duration_ms", 0.95, ["provider_code"]).select("provider_code", F.round("percentile", 4).alias("p95_ms"))
    c = d.join(cases, "run_id").groupBy("provider_code").agg(*(said("state", x).alias(f"cases_{x.lower()}") for x in ("OPEN", "CLOSED")))
    out = g.join(late, "provider_code", "left").join(c, "provider_code", "left")
    return out.na.fill(0, ["cases_open", "cases_closed"])


def candidate_source_report(pages: DataFrame) -> DataFrame:
    """By host (lower case, null where the url has none): pages, pages that are not plain https or carry credentials, pages
    without content, surplus copies of one content."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    plain = F.coalesce(F.col("url").rlike(r"^https://[^/@]+(/|$)"), F.lit(False))
    secret = F.coalesce(F.col("url").rlike(r"^[A-Za-z]+://[^/@]*@"), F.lit(False))
    body = F.coalesce("html", F.lit(""))
    d = pages.select(host.alias("host"), plain.alias("plain"), secret.alias("secret"), F.sha2(body, 256).alias("h"), (F.trim(body) == "").alias("empty"))
    g = d.groupBy("host", "h").agg(F.count("*").alias("n"), F.count_if(~F.col("plain")).alias("x"), F.count_if("secret").alias("s"), F.count_if("empty").alias("e"))
    return g.groupBy("host").agg(F.sum("n").alias("n_pages"), F.sum("x").alias("not_https"), F.sum("s").alias("with_credentials"), F.sum("e").alias("missing_pages"), (F.sum("n") - F.count("*")).alias("duplicate_pages"))


def candidate_source_counts(sources: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): candidate sources by each value of each column, as of status, content and rights; null is a value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    return sources.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x = a.select(key).subtract(b.select(key)).withColumn("side", F.lit("missing"))
    return x.unionByName(b.select(key).subtract(a.select(key)).withColumn("side", F.lit("extra")))


def intake_triage(hashes: DataFrame, ledger: DataFrame, near: DataFrame, order: str = "id", working: DataFrame | None = None) -> DataFrame:
    """(id, state, reason): withdrawn, exact duplicate of an earlier record, near duplicate of the first earlier one, else open:
    to be de-identified where working lists it as transcribed, to be transcribed otherwise. The reason names the original.

    near is references.near_counts of the hashes: (order, first_near), the first record of another hash within the distance."""
    first = hashes.groupBy("hi", "lo").agg(F.min(order).alias("first"))
    after = near.where(F.col("first_near") < F.col(order)).select(order, F.col("first_near").alias("near"))
    gone = ledger.select(order).distinct().withColumn("gone", F.lit(True))
    d = hashes.join(first, ["hi", "lo"]).join(after, order, "left").join(gone, order, "left")
    d = d.withColumn("done", F.lit(False)) if working is None else d.join(working.select(order).distinct().withColumn("done", F.lit(True)), order, "left")
    later = F.col(order) > F.col("first")
    state = F.when(F.col("gone"), "withdrawn").when(later, "exact_duplicate").when(F.col("near").isNotNull(), "near_duplicate").when(F.col("done"), "needs_deidentification").otherwise("needs_transcription")
    original = F.when(F.col("gone"), None).when(later, F.concat(F.lit("exact_duplicate_of:"), "first")).when(F.col("near").isNotNull(), F.concat(F.lit("near_duplicate_of:"), "near"))
    return d.select(order, state.alias("state"), original.alias("reason"))


def latest_run_history(transactions: DataFrame, runs: DataFrame) -> DataFrame:
    """Every transaction with its latest run, if any; the latest comes from a combined aggregate."""
    last = runs.groupBy("transaction_id").agg(F.max_by(F.struct("run_id", "risk_level", "status"), "run_id").alias("r"))
    return transactions.join(last, "transaction_id", "left").select("transaction_id", "r.run_id", "r.risk_level", "r.status")


def bridge_filter(users: DataFrame, roles: DataFrame, key: str, role: str) -> DataFrame:
    return users.join(roles.where(F.col("role") == role), key, "left_semi")


def bucket_policy(df: DataFrame, buckets: dict[str, str]) -> DataFrame:
    """bucket by source (a small literal map); owner rows always train, only controlled rows may reach test."""
    bucket = F.lit("other")
    for source, b in buckets.items():
        bucket = F.when(F.col("source_type") == source, b).otherwise(bucket)
    split = F.when(F.col("bucket") == "owner", "train").when((F.col("split") == "test") & (F.col("bucket") != "controlled"), "train").otherwise(F.col("split"))
    return df.withColumn("bucket", bucket).withColumn("split", split)


def chronological_halves(df: DataFrame, order: str, tie: str | None = None) -> DataFrame:
    """half: the first floor(n / 2) rows in order for fitting, the rest for selecting. tie tells rows of equal order apart."""
    n = df.count()
    by = [F.col(order), *([F.col(tie)] if tie else [])]
    d = running(df, by, {"__k": F.lit(1)})
    return d.withColumn("half", F.when(F.col("__k") <= n // 2, "first").otherwise("second")).drop("__k")


def readiness(df: DataFrame, minimums: dict[str, tuple[int, int]], default: tuple[int, int]) -> DataFrame:
    """By source: records, groups, labels, groups that another source has too, and the blockers: too few records or groups
    (the minimums of the source, or the default ones), one label only, a group in two sources."""
    shared = df.groupBy("group_id").agg(F.count_distinct("source_type").alias("k")).where("k > 1").select("group_id", F.lit(True).alias("shared"))
    d = df.join(shared, "group_id", "left")
    g = d.groupBy("source_type").agg(
        F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"), F.count_distinct("label").alias("n_labels"), F.count_distinct(F.when(F.col("shared"), F.col("group_id"))).alias("shared_groups")
    )
    least = [F.lit(default[k]) for k in (0, 1)]
    for source, m in minimums.items():
        least = [F.when(F.col("source_type") == source, m[k]).otherwise(least[k]) for k in (0, 1)]
    found = codes(GROUP_IN_TWO_SOURCES=F.col("shared_groups") > 0, ONE_LABEL=F.col("n_labels") < 2, TOO_FEW_GROUPS=F.col("n_groups") < least[1], TOO_FEW_RECORDS=F.col("n") < least[0])
    return g.withColumn("blockers", F.array_join(found, ","))


def union_corpora(corpora: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all rows with their corpus, record ids found more than once)."""
    out = None
    for name, d in corpora.items():
        d = d.withColumn("corpus", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out, out.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")


def collection_profile(boxes: DataFrame, cap: int, max_area: int) -> DataFrame:
    """One row: items, those of no size, above the cap, or of too large an area, and the codes of what was found."""
    g = boxes.agg(
        F.count("*").alias("n"), F.count_if((F.col("width") == 0) | (F.col("height") == 0)).alias("no_size"), F.count_if(F.greatest("width", "height") > cap).alias("above_cap"),
        F.count_if(F.col("width").cast("long") * F.col("height") > max_area).alias("oversized"),
    )
    found = codes(DIMENSION_CAP_EXCEEDED=F.col("above_cap") > 0, OVERSIZED_ITEM=F.col("oversized") > 0, ZERO_DIMENSION=F.col("no_size") > 0)
    return g.withColumn("reasons", F.array_join(found, ","))


def dimension_histogram(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("width", "height").agg(F.count("*").alias("n"))
