"""Connected components of a link table, as rounds of joins and groupings (large-star and small-star).

Nothing is collected: each round is written to the shared folder and read back, so lineage stays short and a lost
executor costs one round at most. A hub's links are pre-aggregated to their minimum before any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _star(links: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where(F.col("u") != F.col("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(
        F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("l")
    )
    return small.select("l.u", "l.v").where(F.col("u") != F.col("v")).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each node links to one node at most, and that node to none."""
    branched = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    middle = links.select("u").join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return branched.unionByName(middle).isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v) but the roots; root is the smallest node of its component."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    links = materialise(links.distinct())
    while not _stars(links):
        links = materialise(_star(links))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
