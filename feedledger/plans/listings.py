"""Paged and top-k listings of stored events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedledger.functions.cursors import decode_cursor, encode_cursor
from feedledger.functions.scalars import iso8601

# Page sizes and the greatest identifier.
DEFAULT_LIMIT = 25
MAX_LIMIT = 100
MAX_IDENTIFIER = 2**63 - 1
PERMITTED = ("limit", "cursor", "actor_id", "repository_id")


class InvalidParameter(ValueError):
    """A listing parameter outside what the listing accepts."""

    def __init__(self, parameter: str, detail: str):
        self.parameter = parameter
        super().__init__(f"{parameter} {detail}")


@dataclass(frozen=True)
class PageRequest:
    limit: int = DEFAULT_LIMIT
    cursor: str | None = None
    actor_id: int | None = None
    repository_id: int | None = None


def page_request(**params) -> PageRequest:
    """Checked listing parameters; text is accepted as it comes from a caller."""
    unknown = sorted(set(params) - set(PERMITTED))
    if unknown:
        raise InvalidParameter(unknown[0], "has no meaning in this listing")

    def number(name: str, top: int, message: str) -> int | None:
        value = params.get(name)
        if value is None or not str(value).strip():
            return None
        text = str(value)
        if not (text.isascii() and text.isdigit() and 1 <= int(text) <= top):
            raise InvalidParameter(name, message)
        return int(text)

    limit = number("limit", MAX_LIMIT, f"takes a whole number, 1 up to {MAX_LIMIT}")
    identifier = f"takes an identifier, 1 up to {MAX_IDENTIFIER}"
    cursor = params.get("cursor")
    return PageRequest(
        limit=limit or DEFAULT_LIMIT, cursor=cursor if cursor and str(cursor).strip() else None,
        actor_id=number("actor_id", MAX_IDENTIFIER, identifier),
        repository_id=number("repository_id", MAX_IDENTIFIER, identifier))


def _position(events: DataFrame, cursor: str):
    row = events.sparkSession.range(1).select(decode_cursor(F.lit(cursor)).alias("c")).select("c.*").first()
    if row is None or row["occurred_at"] is None:
        raise InvalidParameter("cursor", "does not come from an earlier page")
    return row


def after(occurred_at: Column, seq: Column) -> Column:
    """Strictly after a position, newest first."""
    return (F.col("occurred_at") <= occurred_at) & (
        (F.col("occurred_at") < occurred_at) | (F.col("seq") < seq))


def event_page(events: DataFrame, request: PageRequest = PageRequest()) -> DataFrame:
    """One page, newest first, with ``next_cursor`` on every row (null on the last page).

    ``limit + 1`` rows are taken to learn whether another page follows.
    """
    scoped = events
    if request.actor_id is not None:
        scoped = scoped.where(F.col("github_actor_id") == request.actor_id)
    if request.repository_id is not None:
        scoped = scoped.where(F.col("github_repository_id") == request.repository_id)
    if request.cursor is not None:
        position = _position(events, request.cursor)
        scoped = scoped.where(after(F.lit(position["occurred_at"]), F.lit(position["seq"])))
    newest = [F.desc("occurred_at"), F.desc("seq")]
    # At most limit + 1 rows reach this window.
    taken = scoped.orderBy(*newest).limit(request.limit + 1).withColumn(
        "_n", F.row_number().over(Window.orderBy(*newest)))
    totals = taken.agg((F.count("*") > request.limit).alias("_more"),
                       F.max(F.when(F.col("_n") == request.limit, encode_cursor(
                           F.col("occurred_at"), F.col("seq")))).alias("_cursor"))
    return (taken.where(F.col("_n") <= request.limit).crossJoin(F.broadcast(totals))
            .withColumn("next_cursor", F.when(F.col("_more"), F.col("_cursor")))
            .drop("_n", "_more", "_cursor"))


def _only(entities: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """Entities a page refers to. The page has at most ``MAX_LIMIT`` rows, so it is what is sent round."""
    ids = page.select(F.col(key).alias("github_id")).distinct()
    return entities.join(F.broadcast(ids), "github_id", "left_semi")


def with_entities(page: DataFrame, actors: DataFrame, repositories: DataFrame) -> DataFrame:
    """A page with both entities looked up; a missing entity leaves its fields null."""
    a = _only(actors, page, "github_actor_id").select(F.col("github_id").alias("github_actor_id"), F.struct(
        "login", "display_login", "name", "avatar_url", "enrichment_status", "fetched_at").alias("_actor"))
    r = _only(repositories, page, "github_repository_id").select(
        F.col("github_id").alias("github_repository_id"), F.struct(
            "full_name", "name", "description", "language", "enrichment_status", "fetched_at")
        .alias("_repository"))
    return (page.join(F.broadcast(a), "github_actor_id", "left")
            .join(F.broadcast(r), "github_repository_id", "left"))


def event_view(joined: DataFrame, detail: bool = False) -> DataFrame:
    """The shape a caller sees: nested entities, two instants, the payload only in detail."""
    def nested(name: str, id_column: str, fields: tuple[str, ...]) -> Column:
        parts = [F.col(id_column).alias("github_id")]
        parts += [F.col(f"_{name}")[f].alias(f) for f in fields]
        return F.struct(*parts, iso8601(F.col(f"_{name}")["fetched_at"]).alias("fetched_at")).alias(name)

    columns = [
        F.col("github_event_id").alias("id"), F.col("github_push_id").alias("push_id"), F.col("ref"),
        F.col("head_sha"), F.col("before_sha"), iso8601(F.col("occurred_at")).alias("occurred_at"),
        iso8601(F.col("created_at")).alias("ingested_at"),
        nested("actor", "github_actor_id", ("login", "display_login", "name", "avatar_url", "enrichment_status")),
        nested("repository", "github_repository_id",
               ("full_name", "name", "description", "language", "enrichment_status"))]
    if detail:
        columns.append(F.col("raw_payload"))
    if "next_cursor" in joined.columns:
        columns.append(F.col("next_cursor"))
    return joined.select(*columns)


def event_by_id(events: DataFrame, actors: DataFrame, repositories: DataFrame, event_id: str) -> DataFrame:
    """One event with its payload; the id is unique, so the page has one row."""
    found = events.where(F.col("github_event_id") == event_id)
    return event_view(with_entities(found, actors, repositories), detail=True)


def events_with_entities(events: DataFrame, actors: DataFrame, repositories: DataFrame) -> DataFrame:
    """Every event whose actor and repository both exist, with their identifying columns.

    No side is broadcast by hand: the planner sends a small table round and sort-merges
    large ones, splitting skewed keys at run time.
    """
    a = actors.select(F.col("github_id").alias("github_actor_id"), "login",
                      F.col("enrichment_status").alias("actor_status"))
    r = repositories.select(F.col("github_id").alias("github_repository_id"), "full_name",
                            F.col("enrichment_status").alias("repository_status"))
    return events.join(a, "github_actor_id").join(r, "github_repository_id")


def labelled_entities(actors: DataFrame, repositories: DataFrame) -> DataFrame:
    """Both classes in one frame with a label column."""
    shared = ("github_id", "enrichment_status", "enrichment_stage", "created_at")
    return actors.select(F.lit("actor").alias("entity_kind"), F.col("login").alias("identifier"), *shared) \
        .unionByName(repositories.select(F.lit("repository").alias("entity_kind"),
                                         F.col("full_name").alias("identifier"), *shared))


def latest_batches(batches: DataFrame, k: int = 10) -> DataFrame:
    return batches.orderBy(F.desc("started_at"), F.desc("correlation_id")).limit(k).select(
        "request_kind", "entity_kind", "status", "requested_count", "returned_count", "valid_count",
        "missing_count", "invalid_count", "incomplete_results", "started_at")


def latest_observations(observations: DataFrame, k: int = 10) -> DataFrame:
    return observations.orderBy(F.desc("observed_at"), F.desc("observation_id")).limit(k).select(
        "entity_kind", "entity_github_id", "source", "validation_outcome", "observed_at")


def latest_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(k).select(
        "run_id", "status", "started_at", "pages_fetched", "events_created", "duplicates_skipped",
        "events_quarantined", "events_failed")


def most_quarantined(quarantined: DataFrame, k: int | None = None) -> DataFrame:
    """Malformed payloads, the most repeated first; all of them unless ``k`` is given."""
    listed = quarantined.orderBy(F.desc("occurrence_count"), "payload_fingerprint").select(
        "github_event_id", "event_type", "error_code", "occurrence_count", "first_received_at",
        "last_received_at")
    return listed if k is None else listed.limit(k)
