"""One ingestion batch: landed pages into all stored tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedledger.operators.classify import HANDLED_TYPES, classify
from feedledger.operators.dedup import (
    accepted_pushes, dedup_new, delivery_results, quarantine_merge, run_tally,
)
from feedledger.operators.evidence import event_observations
from feedledger.operators.folds import fold_entities
from feedledger.operators.ranking import global_rank
from feedledger.operators.known_ids import remember, stored_among
from feedledger.schemas import ARRIVAL, ENTITY_TABLES, INGESTION_RUNS, PUSH_EVENTS
from feedledger.session import configure, freed_shuffles, stage, staging_area
from feedledger.sources.commits import BUCKETS, CommitConflict, Transaction, claim_batch
from feedledger.sources.pages import explode_envelopes, left_out, page_state, stops_of, walked
from feedledger.sources.tables import read_log, read_snapshot

SNAPSHOTS = {"actor": "actors", "repository": "repositories"}
# A batch that loses the race to commit is worked out again on the new state, so many times.
ATTEMPTS = 5


def push_event_rows(ranked: DataFrame) -> DataFrame:
    """Created deliveries, already numbered, in the columns of the event table."""
    return ranked.select(
        "seq", "github_event_id", "push.github_push_id", "push.github_repository_id",
        "push.github_actor_id", "push.ref", "push.head_sha", "push.before_sha", "push.occurred_at",
        "raw_payload", F.col("received_at").alias("created_at"), F.col("received_at").alias("updated_at"),
    ).select(*PUSH_EVENTS.names)


def created_rows(classified: DataFrame, existing: DataFrame, start: int) -> DataFrame:
    """The deliveries that create an event, numbered, with what folds and results read of them; ``with_texts`` adds the rest.

    Deduplication and the sort by arrival move these narrow rows alone; ``_row`` names the classified row.
    """
    narrow = classified.select(
        *ARRIVAL, "_row", "outcome", "fragment_undefined", "github_event_id", F.struct("push.occurred_at").alias("push"),
        *[F.struct(F.col(kind)["github_id"].alias("github_id")).alias(kind) for kind in SNAPSHOTS])
    return global_rank(dedup_new(narrow, existing), list(ARRIVAL), "seq", start=start)


def with_texts(created: DataFrame, classified: DataFrame, *columns: str) -> DataFrame:
    """Created deliveries with the named columns of their classified rows, which are shuffled once at most."""
    sound = classified.where("outcome = 'push_event' AND NOT fragment_undefined")
    return sound.select("_row", "github_event_id", "received_at", *columns).join(created.select("_row", "seq"), "_row")


def run_rows(states: DataFrame, tally: DataFrame, walks: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per run that the batch holds pages of: how its first page ended it, and its counters.

    ``walks`` and ``earlier`` are those runs' stored rows; a run split over batches stays one
    row, whose counters add up.
    """
    first = states.groupBy("run_id").agg(
        F.max("source_id").alias("source_id"), F.min_by("http_class", "page_no").alias("_class"), F.min("page_no").alias("_first"),
        F.min("received_at").alias("started_at"), F.max("received_at").alias("completed_at"))
    joined = first.join(tally, "run_id", "left")
    numbers = [f.name for f in INGESTION_RUNS.fields if f.dataType.typeName() == "long" and f.name != "source_id"]
    if earlier is not None:
        kept = earlier.select("run_id", *[F.col(c).alias(f"o_{c}") for c in ("source_id", "started_at", "completed_at", *numbers)])
        joined = joined.join(kept, "run_id", "left").join(walks.select("run_id", "first_page", "first_class"), "run_id", "left")
        before = F.coalesce(F.col("first_page") <= F.col("_first"), F.lit(False))
        joined = joined.withColumns({
            "_class": F.when(before, F.col("first_class")).otherwise(F.col("_class")),
            "source_id": F.greatest("source_id", "o_source_id"), "started_at": F.least("started_at", "o_started_at"),
            "completed_at": F.greatest("completed_at", "o_completed_at"),
            **{c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"o_{c}"), F.lit(0)) for c in numbers}})
    read = F.coalesce(F.col("pages_fetched"), F.lit(0)) > 0
    status = (F.when((F.col("_class") == "ok") & read, "completed")
              .when(F.col("_class") == "not_modified", "not_modified")
              .when(F.col("_class").isin("rate_limited", "secondary_limited"), "deferred")
              .otherwise("failed"))
    error = F.when(status == "failed", F.when(
        F.col("_class") == "ok", "page 1: malformed response").otherwise(F.col("_class")))
    return joined.select(
        "run_id", "source_id", status.alias("status"), "started_at", "completed_at",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        error.alias("last_error")).select(*INGESTION_RUNS.names)


def numbered_entities(kind: str, folded: DataFrame, highest: int) -> DataFrame:
    """A folded snapshot with sequence numbers for the entities seen for the first time."""
    names = ENTITY_TABLES[kind].names
    kept = stage(folded, f"fold-{kind}")
    ranked = global_rank(kept.where("seq IS NULL").drop("seq"), ["_arrival"], "seq", start=highest)
    return kept.where("seq IS NOT NULL").select(*names).unionByName(ranked.select(*names))


def ingest_batch(pages: DataFrame, root: str, batch_id: int, max_pages: int | None = None,
                 types: str | Iterable[str] = HANDLED_TYPES, stream: str = "direct", buckets: int = BUCKETS) -> DataFrame:
    """Takes one batch of landed pages into the tables under ``root``; returns the rows of its runs.

    ``batch_id`` counts the batches of ``stream``; the ledger gives it a number of the root's
    own. All tables change by one commit. A batch taken again once it is committed changes
    nothing, a batch older than its stream's last one is refused, and one that meets another
    writer's commit is worked out again on the state that writer left. Classified rows are
    written once and each sink reads back only its columns; no job leaves shuffle files to the next. ``buckets`` is how many a new
    root's snapshots have; a batch rewrites those that hold an entity it names.
    """
    spark: SparkSession = configure(pages.sparkSession)
    root = root.rstrip("/")
    batch, committed = claim_batch(spark, root, stream, batch_id)
    for attempt in range(0 if committed else ATTEMPTS):
        tx = Transaction(spark, root, batch, stream, batch_id, buckets)
        with staging_area(spark, f"batch-{batch}"), freed_shuffles(spark):
            _take(tx, pages, max_pages, types)
        try:
            tx.commit()
            break
        except CommitConflict:
            if attempt == ATTEMPTS - 1:
                raise
    own = read_log(spark, root, "run_batches").where(F.col("batch") == batch).select("run_id")
    return read_snapshot(spark, root, "ingestion_runs").join(own, "run_id", "left_semi")


def _take(tx: Transaction, pages: DataFrame, max_pages: int | None, types: str | Iterable[str]) -> None:
    # Page bodies are read twice and never shuffled: once for the walk, once to classify.
    states = stage(page_state(pages), "pages")
    runs = states.select("run_id").distinct()
    own_walks = tx.touched("walks", runs, "run_id")
    walks = stage(tx.rows("walks", own_walks), "walks")
    stops = stage(stops_of(states, max_pages, walks), "stops")
    # Written, so that the planner knows how few they are and sends them to the pages.
    skipped = stage(left_out(states, stops), "left-out")
    counted = pages.join(skipped, ["run_id", "page_no"], "left_anti")
    verdicts = classify(explode_envelopes(counted), types)
    classified = stage(verdicts.withColumn("_row", F.monotonically_increasing_id()), "classified")
    # Texts are shuffled for one table at a time, for the largest ones last.
    broken = classified.where("outcome = 'quarantined'")
    own = tx.touched("quarantined_events", broken, "payload_fingerprint")
    tx.replace(quarantine_merge(broken, tx.rows("quarantined_events", own)), "quarantined_events", own)

    pushes = classified.where("outcome = 'push_event'")
    existing = stage(stored_among(tx, pushes.select("github_event_id").distinct()), "stored-ids")
    created = stage(created_rows(classified, existing, tx.fact("push_events", "last_seq")), "created")
    tx.append(push_event_rows(with_texts(created, classified, "push", "raw_payload")), "push_events")
    fragments = with_texts(created, classified, "push", "actor_fragment", "repo_fragment")
    tx.append(event_observations(fragments), "observations")
    remember(tx, created)
    new_events = tx.written("push_events").agg(F.max("seq")).first()[0]
    tx.set_fact("push_events", "last_seq", new_events or tx.fact("push_events", "last_seq"))

    accepted = accepted_pushes(classified, created, existing)
    for kind, table in SNAPSHOTS.items():
        own = tx.touched(table, accepted.select(F.col(kind)["github_id"].alias("github_id")), "github_id")
        last = tx.fact(table, "last_seq")
        folded = numbered_entities(kind, fold_entities(kind, accepted, created, tx.rows(table, own)), last)
        tx.replace(folded, table, own)
        tx.set_fact(table, "last_seq", max(last, tx.replaced(table, own).agg(F.max("seq")).first()[0] or 0))

    results = delivery_results(classified, created, existing)
    fetched = states.join(skipped, ["run_id", "page_no"], "left_anti")
    own = tx.touched("ingestion_runs", runs, "run_id")
    earlier = stage(tx.rows("ingestion_runs", own), "runs")
    new_runs = run_rows(states, run_tally(results, fetched), walks, earlier)
    tx.replace(with_untouched(new_runs, earlier, "run_id"), "ingestion_runs", own)
    tx.replace(with_untouched(walked(states, stops, walks), walks, "run_id"), "walks", own_walks)
    tx.append(runs.withColumn("batch", F.lit(tx.batch).cast("long")), "run_batches")


def with_untouched(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The new rows and those of the same buckets that the batch does not name."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))
