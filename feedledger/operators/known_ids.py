"""Index of stored event ids: hash buckets with a Bloom filter each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.session import stage
from feedledger.sources.commits import Transaction

ID_BUCKETS = 64
PROBES = 4
# A bucket's filter has so many words of 64 bits: 10 bits for each of some 100,000 ids. A fuller
# filter lets more ids through to the files, which decide.
WORDS = 1 << 14


def id_bucket(event_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), event_id), F.lit(ID_BUCKETS)).cast("int")


def places(event_id: Column) -> list[tuple[Column, Column]]:
    """The ``PROBES`` bits an id has in the filter of its bucket: each as its word and a mask."""
    hashes = [F.xxhash64(F.lit(probe), event_id) for probe in range(PROBES)]
    return [(F.pmod(F.shiftright(h, 6), F.lit(WORDS)).cast("int"),
             F.call_function("shiftleft", F.expr("1L"), h.bitwiseAND(F.lit(63)).cast("int"))) for h in hashes]


def probes(ids: DataFrame) -> DataFrame:
    """The bits each id has in the filter of its bucket: ``github_event_id``, ``id_bucket``, ``word``, ``bit``."""
    bits = F.array(*[F.struct(word.alias("word"), bit.alias("bit")) for word, bit in places(F.col("github_event_id"))])
    return ids.select("github_event_id", "id_bucket", F.inline(bits))


def whole_filters(bloom: DataFrame) -> DataFrame:
    """One row per bucket with all its words in order: at most ``ID_BUCKETS`` rows of ``WORDS`` words."""
    zeros = bloom.select("id_bucket").distinct().select(
        "id_bucket", F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bloom.select("id_bucket", "word", "bits").unionByName(zeros).groupBy("id_bucket", "word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return words.groupBy("id_bucket").agg(ordered["bits"].alias("words"))


def maybe_known(ids: DataFrame, bloom: DataFrame) -> DataFrame:
    """The ids all of whose bits are set; every stored id is among them.

    The filters are of fixed size and go round whole, so no id is shuffled to meet its words.
    """
    placed = ids.join(F.broadcast(whole_filters(bloom)), "id_bucket")
    for word, bit in places(F.col("github_event_id")):
        placed = placed.where(F.get("words", word).bitwiseAND(bit) != 0)
    return placed.select("id_bucket", "github_event_id")


def stored_among(tx: Transaction, ids: DataFrame) -> DataFrame:
    """Which of the distinct ``ids`` (``github_event_id``) are stored; only buckets that may hold one are opened.

    The filters of the touched buckets are read first. A bucket all of whose new ids are missing
    from its filter is not opened, so a batch of new events reads filters alone, however long
    the history. What comes to the driver is a list of at most ``ID_BUCKETS`` numbers.
    """
    placed = ids.select("github_event_id", id_bucket(F.col("github_event_id")).alias("id_bucket"))
    touched = tx.touched("id_bloom", placed, "id_bucket")
    maybe = stage(maybe_known(placed, tx.rows("id_bloom", touched)), "maybe-known")
    opened = sorted(r[0] for r in maybe.select("id_bucket").distinct().collect())
    stored = tx.rows("event_ids").where(F.col("id_bucket").isin(opened)) if opened else tx.rows("event_ids").limit(0)
    # The new ids are few beside the history, which is filtered where it lies.
    return stored.join(maybe, ["id_bucket", "github_event_id"], "left_semi").select("github_event_id").distinct()


def remember(tx: Transaction, created: DataFrame) -> None:
    """Adds the created events' ids to the index, and their bits to the filters of their buckets."""
    new = stage(created.select("github_event_id", id_bucket(F.col("github_event_id")).alias("id_bucket")), "new-ids")
    touched = tx.touched("id_bloom", new, "id_bucket")
    if not touched:
        return
    tx.append(new.repartition("id_bucket"), "event_ids")
    words = probes(new).select("id_bucket", "word", F.col("bit").alias("bits")).unionByName(tx.rows("id_bloom", touched))
    tx.replace(words.groupBy("id_bucket", "word").agg(F.bit_or("bits").alias("bits")), "id_bloom", touched)
