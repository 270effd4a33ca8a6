"""Shards of nearly equal bytes: minimax contiguous partition of atomic groups (operator 9)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedledger.session import stage

SALTS = 4096
CANDIDATES = 32


def _prefix_table(sized: DataFrame) -> DataFrame:
    """Per group, in the order of its key: ``bytes`` and ``upto``, the bytes up to and with it.

    The keys are hashes, so their first 12 bits cut the order into 4096 even buckets whatever
    the data; only their sums pass through one task.
    """
    groups = sized.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("bucket", F.substring(F.hex("key"), 1, 3))
    groups = stage(groups, "groups")
    sums = groups.groupBy("bucket").agg(F.sum("bytes").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("bucket", F.coalesce(earlier, F.lit(0)).alias("before"))
    running = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    table = (groups.repartitionByRange("bucket").withColumn("running", running).join(F.broadcast(before), "bucket")
             .select("key", "bytes", (F.col("before") + F.col("running")).alias("upto")))
    return stage(table.sortWithinPartitions("upto"), "prefix-sums")


def _reach(table: DataFrame, limits: list[int], largest: int) -> list[int | None]:
    """For each limit the largest ``upto`` not beyond it, or None.

    Neighbouring sums differ by the largest group at most, so only a band below each limit is
    read, which the order of the table lets the scan prune. A limit takes its sum from its own
    band alone; no limit may lie beyond the last sum, where a band can be empty.
    """
    upto = F.col("upto")
    bands = [upto.between(x - largest, x) for x in limits]
    return list(table.where(reduce(or_, bands)).agg(*[F.max(F.when(here, upto)).alias(f"r{i}") for i, here in enumerate(bands)]).first())


def smallest_capacity(table: DataFrame, shards: int, total: int, largest: int) -> int:
    """The smallest capacity with which ``shards`` shards, filled in order, take every group.

    A bisection that tries ``CANDIDATES`` capacities at a time, each checked greedily; a round
    costs one narrow aggregate per shard.
    """
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    while low < high:
        step = max(1, (high - low) // (CANDIDATES + 1))
        tried = list(range(low, high, step))[:CANDIDATES + 1]
        at = [0] * len(tried)
        for _ in range(shards):
            open_ = [i for i, a in enumerate(at) if a < total]
            for i, found in zip(open_, _reach(table, [min(at[i] + tried[i], total) for i in open_], largest) if open_ else [], strict=True):
                at[i] = at[i] if found is None else found
        good = next((i for i, a in enumerate(at) if a == total), None)
        if good is None:
            low = tried[-1] + 1
        else:
            high = tried[good]
            low = tried[good - 1] + 1 if good else high
    return high


def cut_points(table: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    """Where each shard but the last ends, as sums of bytes.

    No shard exceeds the smallest capacity. Among such cuts each is put as near to an even
    share of what remains as the shards after it allow.
    """
    capacity = smallest_capacity(table, shards, total, largest)
    upto, lowest, at = F.col("upto"), [total], total
    for _ in range(shards - 1):
        need = at - capacity
        at = 0 if need <= 0 else table.where(upto.between(need, need + largest)).agg(F.min("upto")).first()[0]
        lowest.append(at)
    lowest.reverse()  # lowest[s]: where shard s must end at the earliest
    cuts, at = [], 0
    for s in range(shards - 1):
        target = max(lowest[s], min(at + capacity, at + -(-(total - at) // (shards - s))))
        below, above = table.where(upto.between(target - largest, target + largest)).agg(
            F.max(F.when(upto <= target, upto)), F.min(F.when(upto >= target, upto))).first()
        fits = [x for x in (below, above) if x is not None and max(lowest[s], at) <= x <= at + capacity]
        at = min(fits, key=lambda x: abs(x - target)) if fits else at
        cuts.append(at)
    return cuts


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: equal texts form one atomic group, groups are ordered by the hash of
    their text, and the order is cut so that the largest shard is as small as it can be. ``size``
    is the text's bytes plus 1 (null counts as none). ``slot`` counts a shard's rows from 0 without gaps;
    ``grown_shard`` is null under this law. A null id is a value of its own; repeated rows have slots of
    their own; other columns are ignored; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stage(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text.cast("binary"))).alias("key")), "sized")
    table = _prefix_table(sized)
    total, largest = table.agg(F.max("upto"), F.max("bytes")).first()
    place: Column = F.lit(0)
    if total:
        cuts = cut_points(table, shards, total, largest)
        keys = dict(table.where(F.col("upto").isin([c for c in cuts if c])).select("upto", "key").collect())  # one per cut
        for cut in cuts:
            place = place + (F.lit(1) if not cut else (F.col("key") > F.lit(bytes(keys[cut]))).cast("int"))
    placed = sized.select("id", "size", "crc", place.cast("int").alias("shard"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))  # at most shards * SALTS rows
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("shard", "salt", F.coalesce(earlier, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("id", "crc", "size")) - 1
    return (placed.withColumn("own", own).join(F.broadcast(before), ["shard", "salt"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
