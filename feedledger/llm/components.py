"""Connected components of an edge table, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedledger.session import stage


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """One row per node that has an edge to another node: ``node``, ``component`` (its smallest node).

    Each round hangs the larger neighbours of every node on the smallest node it knows, then
    the smaller ones, so paths halve and the edges end as one star per component. Minima are
    partial aggregates and the joins are on single nodes, so a node with very many neighbours
    is neither gathered nor windowed. Every round is written to the shared folder, which cuts
    the lineage. Null ends and loops are no edges; an empty table has no components.
    """
    a, b = F.col(left), F.col(right)
    stars = stage(edges.where(a.isNotNull() & b.isNotNull() & (a != b))
                  .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _settled(stars):
        both = stars.union(stars.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = stage(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lowest.select("u", F.col("m").alias("v"))).distinct())
        stars = stage(small, "small-star")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs on one smaller node at most, and none that others hang on hangs itself."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        stars.select("v", F.lit(0), F.lit(1)))
    return (ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
            .where("hangs > 1 or hangs = 1 and holds = 1").isEmpty())
