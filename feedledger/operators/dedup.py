"""First delivery per event, and the quarantine merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedledger.schemas import ARRIVAL

COUNTERS = (
    "pages_fetched", "events_received", "push_events_seen", "events_created",
    "duplicates_skipped", "events_quarantined", "events_ignored", "events_failed",
)


def arrival_key():
    """Unique per delivered element, and sorted the way elements arrived."""
    return F.struct(*ARRIVAL)


def known_ids(ids: DataFrame, existing: DataFrame) -> DataFrame:
    """Which of ``ids`` are already stored.

    The stored side is only filtered by the new ids, so a small batch is broadcast to the
    scan of the history and the history itself is never shuffled.
    """
    return (existing.select("github_event_id")
            .join(ids.select("github_event_id").distinct(), "github_event_id", "left_semi").distinct())


def dedup_new(classified: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The deliveries that create an event: the first sound one of every unknown id.

    ``min_by`` is combined on the map side, so an id delivered a billion times sends one
    row per task. A push whose fragments have no digest cannot be created and does not
    take the id.
    """
    sound = classified.where("outcome = 'push_event' AND NOT fragment_undefined")
    columns = [c for c in sound.columns if c != "github_event_id"]
    first = (sound.groupBy("github_event_id")
             .agg(F.min_by(F.struct(*columns), arrival_key()).alias("_first"))
             .select("github_event_id", "_first.*"))
    if existing is None:
        return first
    return first.join(known_ids(first, existing), "github_event_id", "left_anti")


def delivery_results(classified: DataFrame, created: DataFrame,
                     existing: DataFrame | None = None) -> DataFrame:
    """One narrow row per delivery with its result: created, duplicate, quarantined, ignored, failed.

    Pushes meet the created rows on id and arrival together, so the deliveries of one hot
    id spread over all tasks.
    """
    narrow = classified.select(
        *ARRIVAL, "outcome", "push_typed", "github_event_id", "fragment_undefined")
    keys = ["github_event_id", *ARRIVAL]
    winners = created.select(*keys, F.lit(True).alias("_won"))
    sound = (narrow.where("outcome = 'push_event' AND NOT fragment_undefined")
             .join(winners, keys, "left")
             .select(*ARRIVAL, "push_typed", "github_event_id",
                     F.when(F.col("_won"), "created").otherwise("duplicate").alias("result")))
    # A push that cannot be evidenced is a duplicate once its id is taken, and fails before.
    taken = created.select("github_event_id", arrival_key().alias("_taken"))
    broken = (narrow.where("outcome = 'push_event' AND fragment_undefined")
              .join(taken, "github_event_id", "left"))
    if existing is not None:
        stored = known_ids(narrow.where("outcome = 'push_event' AND fragment_undefined"), existing)
        broken = broken.join(stored.withColumn("_stored", F.lit(True)), "github_event_id", "left")
    else:
        broken = broken.withColumn("_stored", F.lit(False))
    broken = broken.select(
        *ARRIVAL, "push_typed", "github_event_id",
        F.when(F.coalesce(F.col("_stored"), F.lit(False))
               | F.coalesce(F.col("_taken") < arrival_key(), F.lit(False)), "duplicate")
        .otherwise("failed").alias("result"))
    rest = narrow.where("outcome <> 'push_event'").select(
        *ARRIVAL, "push_typed", "github_event_id", F.col("outcome").alias("result"))
    return sound.unionByName(broken).unionByName(rest)


def accepted_pushes(classified: DataFrame, created: DataFrame,
                    existing: DataFrame | None = None) -> DataFrame:
    """Deliveries whose identity counts: all pushes but those that failed on evidence."""
    pushes = classified.where("outcome = 'push_event'")
    sound = pushes.where("NOT fragment_undefined")
    broken = pushes.where("fragment_undefined")
    failed = (delivery_results(broken, created, existing)
              .where("result = 'failed'").select("github_event_id", *ARRIVAL))
    return sound.unionByName(broken.join(failed, ["github_event_id", *ARRIVAL], "left_anti"))


def run_tally(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Counters per run, runs whose pages were all empty included."""
    def count(result: str, name: str):
        return F.count_if(F.col("result") == result).alias(name)

    events = results.groupBy("run_id").agg(
        F.count("*").alias("events_received"), F.count_if("push_typed").alias("push_events_seen"),
        count("created", "events_created"), count("duplicate", "duplicates_skipped"),
        count("quarantined", "events_quarantined"), count("ignored", "events_ignored"),
        count("failed", "events_failed"))
    fetched = pages.groupBy("run_id").agg(F.count("*").alias("pages_fetched"))
    joined = fetched.join(events, "run_id", "left")
    return joined.select("run_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def tally_identities(tally: DataFrame) -> DataFrame:
    """Runs whose counters contradict each other; empty when all is well."""
    total = (F.col("events_created") + F.col("duplicates_skipped") + F.col("events_quarantined")
             + F.col("events_ignored") + F.col("events_failed"))
    accounted = total == F.col("events_received")
    typed = F.col("push_events_seen") <= F.col("events_received") - F.col("events_ignored")
    return tally.where(~accounted | ~typed)


def quarantine_merge(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """One row per payload digest: counts add up, the first classification stays.

    ``new`` holds classified rows; ``old`` is the stored table.
    """
    first_fields = ("github_event_id", "event_type", "error_code", "error_message", "raw_payload")
    fresh = (new.where("outcome = 'quarantined'").groupBy("payload_fingerprint").agg(
        F.min_by(F.struct(*first_fields), arrival_key()).alias("_first"),
        F.min("received_at").alias("first_received_at"), F.max("received_at").alias("last_received_at"),
        F.count("*").alias("occurrence_count"),
        F.min_by("received_at", arrival_key()).alias("created_at"))
        .withColumn("updated_at", F.col("last_received_at")))
    if old is None:
        merged = fresh.select("payload_fingerprint", "_first.*", "first_received_at", "last_received_at",
                              "occurrence_count", "created_at", "updated_at")
    else:
        kept = old.select("payload_fingerprint", F.struct(*first_fields).alias("_old"),
                          *[F.col(c).alias(f"_{c}") for c in (
                              "first_received_at", "last_received_at", "occurrence_count",
                              "created_at", "updated_at")])
        both = fresh.join(kept, "payload_fingerprint", "full")
        first = F.when(F.col("_old").isNotNull(), F.col("_old")).otherwise(F.col("_first"))
        merged = both.select(
            "payload_fingerprint", *[first[c].alias(c) for c in first_fields],
            F.coalesce("_first_received_at", "first_received_at").alias("first_received_at"),
            F.greatest("_last_received_at", "last_received_at").alias("last_received_at"),
            (F.coalesce("_occurrence_count", F.lit(0)) + F.coalesce("occurrence_count", F.lit(0)))
            .cast("long").alias("occurrence_count"),
            F.coalesce("_created_at", "created_at").alias("created_at"),
            F.greatest("_updated_at", "updated_at").alias("updated_at"))
    return merged
