"""Running sums, ranks and exact percentiles over whole tables, without a window that gathers all rows in one task.

Two passes: the rows are dealt to range partitions in their order, as many as the data need, and stored with the number of
their part; the sums of the parts, accumulated, are the offsets from which the rows of each part are accumulated. The
range goes by the row's own number last, so that a value of any number of rows is spread over parts.

running() runs jobs while a plan is being built: it stores its input, counts it, and stores it again by parts. What it
returns reads the stored rows, so that the plan of its input runs once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rows of a part, on average.
PART_ROWS = 1 << 20


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with sums of the rows up to each in order, inside each group of by (null is a group). order may be descending."""
    by = by or []
    d = stored(df.select("*", *(c.alias(f"__{k}") for k, c in sums.items()), F.monotonically_increasing_id().alias("__row")))
    parts = math.ceil(d.count() / PART_ROWS)
    d = stored(d.repartitionByRange(parts, *by, *order, "__row").withColumn("__part", F.spark_partition_id())) if parts > 1 else d.withColumn("__part", F.lit(0))
    totals = d.groupBy(*by, "__part").agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__from_{k}") for k in sums))
    match = F.col("__part") == F.col("__p")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # One row for each part, and for each group that lies in it; their size decides whether they are broadcast.
    d = d.join(starts, match)
    inside = Window.partitionBy(*by, "__part").orderBy(*order, "__row").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(*df.columns, *((F.sum(f"__{k}").over(inside) + F.col(f"__from_{k}")).alias(k) for k in sums))


def exact_percentile(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """(by, percentile): the exact percentile of the values that are not null, between neighbours as a straight line."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__m"))
    ranked = running(counts, [F.col(value)], {"__c": F.col("__m")}, by)
    n = ranked.groupBy(*by).agg(((F.sum("__m") - 1) * F.lit(q)).alias("__h"))
    for c in by:
        n = n.withColumnRenamed(c, f"__k_{c}")
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    d = ranked.join(F.broadcast(n) if not by else n, match)
    h = F.col("__h")
    first = lambda rank: F.min(F.when(F.col("__c") > rank, F.col(value)))
    g = d.groupBy(*by, "__h").agg(first(F.floor(h)).alias("__lo"), first(F.ceil(h)).alias("__hi"))
    return g.select(*by, (F.col("__lo") + (h - F.floor(h)) * (F.col("__hi") - F.col("__lo"))).cast("double").alias("percentile"))
