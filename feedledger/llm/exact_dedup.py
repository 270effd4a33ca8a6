"""Exact deduplication by an extendible-hash index on shared files (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from feedledger.llm.worker import ship
from feedledger.session import stage

ship(__name__)

MAX_DEPTH = 16
# Deleted from a text before texts are compared: space and the characters 9 to 13.
DELETED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ``DELETED`` characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in DELETED:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def double_directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int, int]]:
    """Directory entries (slot, bucket, local depth, pages) for so many rows per slot of full depth.

    It starts with one bucket. While a bucket holds more than ``capacity`` rows the directory
    doubles, and each overfull bucket splits by its next hash bit. What is still overfull at
    full depth is most likely one key; it gets overflow pages of ``capacity`` rows each.
    """
    full = 1 << max_depth
    rows = [0] * full
    for slot, n in counts.items():
        rows[slot] = n
    levels = [rows]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([below[i] + below[i + 1] for i in range(0, len(below), 2)])
    levels.reverse()  # levels[d][prefix]: rows below a prefix of d bits
    entries, overfull, depth, buckets = [], [0], 0, 0
    while overfull:
        split = []
        for prefix in overfull:
            n = levels[depth][prefix]
            if n > capacity and depth < max_depth:
                split += [2 * prefix, 2 * prefix + 1]
                continue
            width = max_depth - depth
            pages = max(1, -(-n // capacity))
            entries += [(slot, buckets, depth, pages) for slot in range(prefix << width, (prefix + 1) << width)]
            buckets += 1
        overfull, depth = split, depth + 1
    return entries


def _chain(rows: DataFrame, keep_bytes: Column) -> DataFrame:
    """Owner tasks: gives equal bytes under one hash the same ``chain`` number.

    ``rows`` come sorted by (bucket, page, hash). A task holds the distinct byte strings of the
    hash it is at, a chain nearly always of one link, and compares each row with them; rows
    of a key stream past and are never gathered. ``link`` is the bytes of a chain's first row
    where ``keep_bytes`` holds.
    """
    carried = [c for c in rows.columns if c not in ("body", "keep")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, {}
        for batch in batches:
            numbers, links = [], []
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "page", "hash")), strict=True)
            for at, body, keep in zip(keys, batch.column("body"), batch.column("keep").to_pylist(), strict=True):
                if at != key:
                    key, chain = at, {}
                raw = body.as_py()
                new = raw not in chain
                numbers.append(chain.setdefault(raw, len(chain)))
                links.append(raw if new and keep else None)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(numbers, pa.int64()), pa.array(links, pa.string())],
                                             names=[*carried, "chain", "link"])

    schema = T.StructType([f for f in rows.schema.fields if f.name in carried]).add("chain", "long").add("link", "string")
    return rows.withColumn("keep", keep_bytes).mapInArrow(run, schema)


def build_index(docs: DataFrame, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index entries on shared files: one per row of ``docs``.

    Columns: ``id``, ``row`` (a number of the row), ``hash``, ``chars`` of the original text, ``sha256`` of
    the normalised one, and ``chain``; two rows have equal texts when hash and chain are equal.
    The directory has 2**16 slots whatever the data, so its counts may pass through the driver
    and its entries be broadcast. Buckets of rows spread over owner tasks; a bucket's capacity is
    by default a quarter of a task's even share. A key too frequent for one bucket goes over
    pages by row, and the pages' first rows, a few per key, are chained once more.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), normalised(text).alias("body"), F.length(F.coalesce(text, F.lit(""))).alias("chars"))
    keyed = keyed.withColumn("hash", F.xxhash64("body")).withColumn("slot", F.shiftrightunsigned("hash", 64 - MAX_DEPTH).cast("int"))
    counts = {r[0]: r[1] for r in keyed.groupBy("slot").count().collect()}  # at most 2**16 rows
    if capacity is None:
        capacity = max(1, -(-sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    directory = spark.createDataFrame(double_directory(counts, capacity), "slot int, bucket int, depth int, pages int")
    salt = F.pmod(F.xxhash64("id", "chars", F.monotonically_increasing_id()), F.col("pages"))
    routed = (keyed.join(F.broadcast(directory), "slot")
              .withColumn("page", F.when(F.col("pages") > 1, salt).otherwise(F.lit(0)))
              .withColumn("sha256", F.sha2("body", 256))
              .select("id", "chars", "sha256", "hash", "bucket", "page", "pages", "body"))
    owned = routed.repartition("bucket", "page").sortWithinPartitions("bucket", "page", "hash")
    entries = stage(_chain(owned, F.col("pages") > 1).withColumn("row", F.monotonically_increasing_id()), "hash-index")
    firsts = (entries.where(F.col("link").isNotNull())
              .select("hash", F.col("page").alias("at_page"), F.col("chain").alias("at_chain"), F.col("link").alias("body"),
                      F.lit(0).alias("bucket"), F.lit(0).alias("page")))
    merged = _chain(firsts.repartition("hash").sortWithinPartitions("hash", "at_page", "at_chain"), F.lit(False))
    merged = merged.select(F.col("hash").alias("m_hash"), "at_page", "at_chain", F.col("chain").alias("m_chain"))
    return (entries.join(merged, (F.col("hash") == F.col("m_hash")) & (F.col("page") == F.col("at_page"))
                         & (F.col("chain") == F.col("at_chain")), "left")
            .select("id", "row", "hash", "chars", "sha256", F.coalesce("m_chain", "chain").alias("chain")))


def dedup(docs: DataFrame, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the one with the most code points stays, then the smallest id (null counts
    as smallest), then, of rows repeated whole, one of them. Null and empty texts are equal, also to
    texts of deleted characters only. Other columns are ignored.
    """
    entries = stage(build_index(docs, capacity, id_col, text_col), "hash-entries")
    winners = entries.groupBy("hash", "chain").agg(
        F.count("*").alias("group_size"), F.min(F.struct((-F.col("chars")).alias("c"), "id", "row")).alias("best"))
    return (entries.join(winners, ["hash", "chain"])
            .select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha256").alias("text_sha256")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, with all their columns; of repeated rows one."""
    judged = dedup(docs, None, id_col, text_col)
    kept = judged.where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumn("__own", F.sha2(normalised(F.col(text_col)), 256))
    rows = own.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi")
    repeated = judged.where(F.col(id_col).eqNullSafe(F.col("keep_id")) & ~F.col("kept")).limit(1).count()
    return (rows.dropDuplicates([id_col, "__own"]) if repeated else rows).drop("__own")
