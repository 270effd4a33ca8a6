"""Order-dependent folds of accepted events into actor and repository rows.

Arrival order starts with the arrival instant, so inside one batch instants never run
backwards and every observation is fresh against the ones before it. Only the stored row
can be newer. The last non-null value of a field therefore applies exactly if its own
instant is not older than the stored ``updated_at``: a plain aggregate, combined on the
map side, with one join per entity instead of a window over all its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.operators.dedup import arrival_key
from feedledger.schemas import ARRIVAL, ENTITY_TABLES, IDENTITY_FIELDS


def observations_of(kind: str, deliveries: DataFrame) -> DataFrame:
    """Identity observations of one class: github_id, its fields, and the arrival key."""
    return deliveries.select(*ARRIVAL, *[
        F.col(kind)[name].alias(name) for name in ("github_id", *IDENTITY_FIELDS[kind])])


def identity_latest(kind: str, observations: DataFrame) -> DataFrame:
    """Per entity and field, the last non-null value with the instant it arrived."""
    fields = IDENTITY_FIELDS[kind]
    return observations.groupBy("github_id").agg(
        *[F.max_by(F.when(F.col(f).isNotNull(), F.struct(F.col("received_at").alias("at"), F.col(f).alias("value"))),
                   F.when(F.col(f).isNotNull(), arrival_key())).alias(f"_{f}") for f in fields],
        F.min("received_at").alias("_first_at"), F.max("received_at").alias("_last_at"),
        F.min(arrival_key()).alias("_arrival"))


def identity_fold(kind: str, observations: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Identity columns after the batch: ``github_id``, fields, ``created_at``, ``updated_at``.

    Stored entities the batch does not mention are kept as they are.
    """
    fields = IDENTITY_FIELDS[kind]
    latest = identity_latest(kind, observations)
    if old is None:
        return latest.select("github_id", *[F.col(f"_{f}.value").alias(f) for f in fields],
                             F.col("_first_at").alias("created_at"), F.col("_last_at").alias("updated_at"))
    stored = old.select("github_id", F.lit(True).alias("_stored"),
                        *[F.col(f).alias(f"o_{f}") for f in fields],
                        F.col("created_at").alias("o_created_at"), F.col("updated_at").alias("o_updated_at"))
    both = latest.join(stored, "github_id", "full")
    return both.select(
        "github_id", *[_merged_field(f).alias(f) for f in fields],
        F.coalesce("o_created_at", "_first_at").alias("created_at"),
        F.greatest("o_updated_at", "_last_at").alias("updated_at"))


def _merged_field(field: str) -> Column:
    found = F.col(f"_{field}")
    fresh = F.col("o_updated_at").isNull() | (found["at"] >= F.col("o_updated_at"))
    return F.coalesce(F.when(fresh, found["value"]), F.col(f"o_{field}"))


def activity(kind: str, created: DataFrame) -> DataFrame:
    """Activity and first-stage instants per entity, from created events only."""
    return (created.select(
        F.col(kind)["github_id"].alias("github_id"), "received_at",
        F.col("push.occurred_at").alias("occurred_at"))
        .groupBy("github_id").agg(
            F.min("received_at").alias("_seen_first"), F.max("received_at").alias("_seen_last"),
            F.max("occurred_at").alias("_event_last")))


def activity_fold(kind: str, created: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """``first_seen_at``, ``last_seen_at``, ``latest_event_at`` and the three stage instants."""
    fresh = activity(kind, created)
    names = ("first_seen_at", "last_seen_at", "latest_event_at", "event_native_at", "derived_at",
             "batch_pending_at")
    if old is None:
        old = created.sparkSession.createDataFrame([], ENTITY_TABLES[kind])
    both = fresh.join(old.select("github_id", *names), "github_id", "full")
    return both.select("github_id", *[c.alias(n) for n, c in _activity_columns().items()])


def _activity_columns() -> dict[str, Column]:
    return {
        "first_seen_at": F.least("first_seen_at", "_seen_first"),
        "last_seen_at": F.greatest("last_seen_at", "_seen_last"),
        "latest_event_at": F.greatest("latest_event_at", "_event_last"),
        "event_native_at": F.coalesce("event_native_at", "_seen_first"),
        "derived_at": F.coalesce("derived_at", "_seen_first"),
        "batch_pending_at": F.coalesce("batch_pending_at", "_seen_first"),
    }


def new_entity_defaults() -> dict[str, Column]:
    """Columns of an entity seen for the first time."""
    return {
        "enrichment_status": F.lit("pending"), "enrichment_stage": F.lit("batch_pending"),
        "enrichment_attempts": F.lit(0), "detail_attempts": F.lit(0),
    }


def first_sightings(kind: str, observations: DataFrame, old: DataFrame) -> DataFrame:
    """Entities not stored yet, one row each, with their arrival and default columns."""
    seen = observations.groupBy("github_id").agg(F.min(arrival_key()).alias("_arrival"))
    new = seen.join(old.select("github_id"), "github_id", "left_anti")
    return new.select("github_id", "_arrival.*", F.col("_arrival.received_at").alias("created_at"), *[
        column.alias(name) for name, column in new_entity_defaults().items()])


def fold_entities(kind: str, accepted: DataFrame, created: DataFrame, old: DataFrame) -> DataFrame:
    """The whole next snapshot of one class, in its table's columns but with ``seq`` unset
    for new rows (``_arrival`` orders them)."""
    schema = ENTITY_TABLES[kind]
    fields = IDENTITY_FIELDS[kind]
    latest = identity_latest(kind, observations_of(kind, accepted))
    active = activity(kind, created)
    o = old.select(*[F.col(c).alias(f"o_{c}") if c in (*fields, "created_at", "updated_at") else F.col(c)
                     for c in schema.names])
    both = o.join(latest, "github_id", "full").join(active, "github_id", "left")
    computed = {f: _merged_field(f) for f in fields}
    computed |= _activity_columns()
    computed |= {n: F.coalesce(F.col(n), d) for n, d in new_entity_defaults().items()}
    computed["created_at"] = F.coalesce("o_created_at", "_first_at")
    computed["updated_at"] = F.greatest("o_updated_at", "_last_at")
    return both.select("_arrival", *[
        (computed[f.name] if f.name in computed else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in schema.fields])
