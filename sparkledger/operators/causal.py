"""Causal features over strictly earlier steps: rows of one step never see each other.

What is the same for all rows of an actor and step is worked out once, in one table of (actor, step): the sums of its rows,
over which RANGE frames on the integer step run, and the turns of its counterparties. These are counted without sets: a
pair seen at a step counts for the k steps after it, or until it is seen again, and the beginnings and ends of these
spans are added up by step. A hot actor has no more rows there than there are steps. The table is joined to the rows once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rows of an initiator from which on its medians are found by counts of values instead of in window frames, and rows of a
#: part of its values.
HOT_ROWS, PART_ROWS = 10_000, 1 << 16


def prior(k: int, actor: str = "actor") -> WindowSpec:
    return Window.partitionBy(actor).orderBy("step").rangeBetween(-k, -1)


def _sums(tx: DataFrame) -> DataFrame:
    """(actor, step) with the count, sums and last type of the initiator's rows."""
    return tx.groupBy(F.col("initiator_id").alias("actor"), "step").agg(
        F.count("*").alias("__n"), F.count("amount").alias("__m"), F.sum("amount").alias("__sum"), F.max_by("transaction_type", "row_no").alias("__last"), F.first("step").alias("__own")
    )


def _joined(tx: DataFrame, steps: DataFrame, names: list[str]) -> DataFrame:
    """tx with columns of its initiator's row of (actor, step)."""
    at = steps.select(F.col("actor").alias("__actor"), F.col("step").alias("__step"), *names)
    on = F.col("initiator_id").eqNullSafe(F.col("__actor")) & F.col("step").eqNullSafe(F.col("__step"))
    return tx.join(at, on).drop("__actor", "__step")


def _velocity(hours: tuple[int, ...] = (1, 6, 24)) -> dict[str, Column]:
    out = {}
    for k in hours:
        out[f"prior_{k}h_count"] = F.coalesce(F.sum("__n").over(prior(k)), F.lit(0))
        out[f"prior_{k}h_amount"] = F.coalesce(F.sum("__sum").over(prior(k)), F.lit(0.0))
    return out


def _mean(k: int) -> Column:
    return F.try_divide(F.sum("__sum").over(prior(k)), F.sum("__m").over(prior(k)))


def _since(k: int) -> Column:
    return F.col("step") - F.max("__own").over(prior(k))


def _from(k: int) -> Column:
    return F.coalesce(F.max_by("__last", "__own").over(prior(k)), F.lit("START"))


def velocity(tx: DataFrame, hours: tuple[int, ...] = (1, 6, 24)) -> DataFrame:
    out = _velocity(hours)
    return _joined(tx, _sums(tx).withColumns(out), list(out))


def prior_medians(tx: DataFrame, k: int = 24) -> DataFrame:
    """(actor, step, prior_median): the exact median of an initiator's amounts over the k steps before each of its steps.

    An initiator of at most HOT_ROWS rows is read in window frames. For the others, which are looked up while the plan is
    built, the different amounts of a step are counted, and dealt to parts by range, as many as they need. The counts of
    the parts, added up over the k steps before, tell in which part the middle amounts lie; only the amounts of that part
    are added up one by one. So no task gathers an initiator, nor the frame of a step."""
    t = tx.select(F.col("initiator_id").alias("actor"), "step", "amount")
    hot = stored(t.groupBy("actor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(F.col("actor").alias("__hot")))
    is_hot = F.col("actor").eqNullSafe(F.col("__hot"))
    rows = t if hot.isEmpty() else t.join(hot, is_hot, "left_anti")
    median = F.percentile("amount", F.lit(0.5)).over(prior(k))
    out = rows.select("actor", "step", median.alias("prior_median")).groupBy("actor", "step").agg(F.first("prior_median").alias("prior_median"))
    return out if hot.isEmpty() else out.unionByName(_counted_medians(t.join(hot, is_hot, "left_semi"), k))


def _counted_medians(t: DataFrame, k: int) -> DataFrame:
    counts = stored(t.groupBy("actor", "step", "amount").agg(F.count("*").alias("n")))
    parts = max(1, math.ceil(counts.count() / PART_ROWS))
    counts = stored(counts.repartitionByRange(parts, "amount").withColumn("part", F.spark_partition_id()))
    targets = counts.select("actor", "step").distinct()
    there = counts.where("amount IS NOT NULL")
    ahead = F.explode(F.sequence(F.col("step") + 1, F.col("step") + k)).alias("to")
    sums = there.groupBy("actor", "step", "part").agg(F.sum("n").alias("n")).select(F.col("actor").alias("__actor"), ahead, "part", "n").groupBy("__actor", "to", "part").agg(F.sum("n").alias("n"))
    seen = sums.join(targets, F.col("actor").eqNullSafe(F.col("__actor")) & (F.col("step") == F.col("to")), "left_semi")
    by = Window.partitionBy("__actor", "to")
    seen = seen.withColumns({"until": F.sum("n").over(by.orderBy("part")), "all": F.sum("n").over(by)})
    rank = lambda a: F.floor((F.col("all") + a) / 2) - F.col("until") + F.col("n")  # noqa: E731  (of the lower and upper middle, inside the part)
    inside = lambda c: F.when((c >= 0) & (c < F.col("n")), c)
    chosen = seen.select("__actor", "to", F.col("part").alias("__part"), inside(rank(-1)).alias("lo"), inside(rank(0)).alias("hi")).where("lo IS NOT NULL OR hi IS NOT NULL")
    asked = chosen.select("*", F.explode(F.sequence(F.col("to") - k, F.col("to") - 1)).alias("at"))
    met = there.join(asked, F.col("actor").eqNullSafe(F.col("__actor")) & (F.col("step") == F.col("at")) & (F.col("part") == F.col("__part")))
    values = met.groupBy("__actor", "to", "part", "amount").agg(F.sum("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    until = F.sum("n").over(Window.partitionBy("__actor", "to", "part").orderBy("amount"))
    values = values.withColumn("until", until)
    first = lambda c: F.min(F.when(F.col("until") > F.col(c), F.col("amount"))).alias(c)
    found = values.groupBy("__actor", "to").agg(first("lo"), first("hi"))
    at = found.select(F.col("__actor"), F.col("to"), (0.5 * F.col("lo") + 0.5 * F.col("hi")).alias("prior_median"))
    return targets.join(at, F.col("actor").eqNullSafe(F.col("__actor")) & (F.col("step") == F.col("to")), "left").select("actor", "step", "prior_median")


def _ratio() -> Column:
    return F.when(F.col("prior_median") != 0, F.col("amount") / F.col("prior_median"))


def prior_summary(tx: DataFrame, k: int = 24) -> DataFrame:
    steps = _sums(tx).withColumn("prior_mean", _mean(k))
    d = _joined(tx, steps, ["prior_mean"])
    return _joined(d, prior_medians(tx, k), ["prior_median"]).withColumn("amount_to_median", _ratio())


def time_since_previous(tx: DataFrame, k: int = 24) -> DataFrame:
    return _joined(tx, _sums(tx).withColumn("steps_since_previous", _since(k)), ["steps_since_previous"])


def sequence_pattern(tx: DataFrame, k: int = 24) -> DataFrame:
    d = _joined(tx, _sums(tx).withColumn("__from", _from(k)), ["__from"])
    return d.withColumn("sequence_pattern", F.concat(F.col("__from"), F.lit("->"), F.col("transaction_type"))).drop("__from")


def _pairs(tx: DataFrame, k: int, both: bool = True) -> DataFrame:
    """(actor, other, step, sent): each step at which a pair is seen, in either direction if both, and whether actor sent.

    any_to and sent_to are the steps from which on the sighting no longer counts, new whether actor had not sent to other in
    the k steps before."""
    seen = tx.select(F.col("initiator_id").alias("actor"), F.col("recipient_id").alias("other"), "step", F.lit(True).alias("sent"))
    if both:
        seen = seen.unionByName(seen.select(F.col("other").alias("actor"), F.col("actor").alias("other"), "step", F.lit(False).alias("sent")))
    seen = seen.groupBy("actor", "other", "step").agg(F.max("sent").alias("sent"))
    w = Window.partitionBy("actor", "other").orderBy("step")
    sent = F.when(F.col("sent"), F.col("step"))
    end = lambda again: F.least(F.col("step") + k, again) + 1  # noqa: E731  (least leaves nulls out)
    return seen.withColumns(
        {
            "any_to": end(F.lead("step").over(w)),
            "sent_to": end(F.min(sent).over(w.rowsBetween(1, Window.unboundedFollowing))),
            "new": F.coalesce(F.col("step") - F.max(sent).over(w.rowsBetween(Window.unboundedPreceding, -1)) > k, F.lit(True)).cast("int"),
        }
    )


def _turns(pairs: DataFrame) -> DataFrame:
    """(actor, step, __any, __sent): by how much the counterparties, and the recipients, of an actor change at a step."""
    known, linked = F.col("other").isNotNull(), F.col("other").isNotNull() & F.col("actor").isNotNull()
    one = lambda at, a, s: F.struct(at.cast("int").alias("step"), a.cast("int").alias("a"), s.cast("int").alias("s"))
    a, s = F.when(linked, 1).otherwise(0), F.when(known & F.col("sent"), 1).otherwise(0)
    turns = F.array(one(F.col("step") + 1, a, s), one(F.col("any_to"), -a, F.lit(0)), one(F.col("sent_to"), F.lit(0), -s))
    d = pairs.select("actor", F.explode(turns).alias("t")).where("t.a <> 0 OR t.s <> 0")
    return d.groupBy("actor", F.col("t.step").alias("step")).agg(F.sum("t.a").alias("__any"), F.sum("t.s").alias("__sent"))


def _so_far(c: str) -> Column:
    w = Window.partitionBy("actor").orderBy("step").rangeBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.sum(c).over(w), F.lit(0)).cast("int")


def _with_new(d: DataFrame, pairs: DataFrame) -> DataFrame:
    """d with is_new_recipient, of its pair at its step."""
    p = pairs.where("sent").select(F.col("actor").alias("__actor"), F.col("other").alias("__other"), F.col("step").alias("__step"), F.col("new").alias("is_new_recipient"))
    on = F.col("initiator_id").eqNullSafe(F.col("__actor")) & F.col("recipient_id").eqNullSafe(F.col("__other")) & F.col("step").eqNullSafe(F.col("__step"))
    return d.join(p, on).drop("__actor", "__other", "__step")


def recipients(tx: DataFrame, k: int = 24) -> DataFrame:
    """unique_recipients over the k steps before, and whether the row's recipient is none of them."""
    pairs = _pairs(tx, k, both=False)
    steps = _sums(tx).select("actor", "step", "__own").unionByName(_turns(pairs), allowMissingColumns=True)
    steps = steps.withColumn("unique_recipients", _so_far("__sent")).where("__own IS NOT NULL")
    return _with_new(_joined(tx, steps, ["unique_recipients"]), pairs)


def graph_degree(tx: DataFrame, k: int = 24) -> DataFrame:
    """(row_no, graph_degree): different counterparties of the initiator in either direction over the k steps before."""
    steps = _sums(tx).select("actor", "step", "__own").unionByName(_turns(_pairs(tx, k)), allowMissingColumns=True)
    steps = steps.withColumn("graph_degree", _so_far("__any")).where("__own IS NOT NULL")
    return _joined(tx, steps, ["graph_degree"]).select("row_no", "graph_degree")


def causal_features(tx: DataFrame, k: int = 24) -> DataFrame:
    """All of the above, from one table of (actor, step) and one of pairs."""
    pairs = _pairs(tx, k)
    steps = _sums(tx).unionByName(_turns(pairs), allowMissingColumns=True)
    out = {"steps_since_previous": _since(k), "__from": _from(k), "prior_mean": _mean(k), "unique_recipients": _so_far("__sent"), "graph_degree": _so_far("__any"), **_velocity()}
    steps = steps.withColumns(out).where("__own IS NOT NULL")
    medians = prior_medians(tx, k).select(F.col("actor").alias("__a"), F.col("step").alias("__s"), "prior_median")
    steps = steps.join(medians, F.col("actor").eqNullSafe(F.col("__a")) & F.col("step").eqNullSafe(F.col("__s"))).drop("__a", "__s")
    d = _with_new(_joined(tx, steps, [*out, "prior_median"]), pairs).withColumn("amount_to_median", _ratio())
    d = d.withColumn("sequence_pattern", F.concat(F.col("__from"), F.lit("->"), F.col("transaction_type"))).drop("__from")
    return d.withColumns({"prior_missing": F.col("prior_mean").isNull().cast("int"), "previous_missing": F.col("steps_since_previous").isNull().cast("int")})
