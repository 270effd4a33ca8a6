"""Global first-in-first-out ranks without a single-task window over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedledger.session import stage

_ROW_BITS = 33


def global_rank(df: DataFrame, order: list[str], rank: str = "rank", start: int | Column = 0,
                partitions: int | None = None) -> DataFrame:
    """Adds ``rank``: 1, 2, 3, ... in the order of ``order``, which must be unique per row.

    Rows are range-sorted once and written to the shared folder with their position inside
    their range; the ranges are then counted from that file, and each row adds the sizes of
    the ranges before its own. The frame of sizes has one row per shuffle partition, so its
    running sum and its broadcast do not grow with the data.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Within one write this id is (partition, row of the sorted partition).
    placed = stage(ranged.withColumn("_id", F.monotonically_increasing_id()), "rank")
    placed = placed.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    base = F.lit(start) if isinstance(start, int) else start
    return (placed.join(F.broadcast(before), "_part")
            .withColumn(rank, (base + F.col("_before") + row + 1).cast("long"))
            .drop("_part", "_before", "_id"))
