"""Explicit schemas of every table, and the value domains their columns are held to."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, STR, TS, BOOL = (
    T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.BooleanType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Domains of the enumerated text columns.
ENTITY_KINDS = ("actor", "repository")
REQUEST_KINDS = ("search", "detail")
BATCH_STATUSES = ("in_flight", "succeeded", "failed", "deferred", "stale_lease")
OBSERVATION_SOURCES = ("event", "search", "detail")
SOURCE_STATUSES = ("idle", "failed")
RUN_STATUSES = ("running", "completed", "not_modified", "deferred", "failed")
SUCCESSFUL_RUN_STATUSES = ("completed", "not_modified")
WINDOW_STATUSES = ("uninitialized", "active", "globally_blocked")
ENRICHMENT_STATUSES = ("pending", "complete", "retryable_failure", "permanent_failure")
ENRICHMENT_STAGES = (
    "batch_pending", "batch_in_flight", "detail_pending", "detail_in_flight",
    "retry_scheduled", "contract_complete", "terminal",
)
CANDIDATE_STATUSES = ("pending", "retryable_failure")
SETTLED_STAGES = ("contract_complete", "terminal")

FETCH_LOG = _table(
    run_id=STR, source_id=LONG, page_no=INT, request_url=STR, received_at=TS, status=INT,
    headers=T.MapType(STR, STR), body=STR,
)

PUSH_EVENTS = _table(
    seq=LONG, github_event_id=STR, github_push_id=LONG, github_repository_id=LONG,
    github_actor_id=LONG, ref=STR, head_sha=STR, before_sha=STR, occurred_at=TS,
    raw_payload=STR, created_at=TS, updated_at=TS,
)

QUARANTINED_EVENTS = _table(
    payload_fingerprint=STR, github_event_id=STR, event_type=STR, error_code=STR,
    error_message=STR, raw_payload=STR, first_received_at=TS, last_received_at=TS,
    occurrence_count=LONG, created_at=TS, updated_at=TS,
)

_LIFECYCLE = dict(
    first_seen_at=TS, last_seen_at=TS, latest_event_at=TS,
    event_native_at=TS, derived_at=TS, batch_pending_at=TS, detail_pending_at=TS,
    retry_scheduled_at=TS, batch_applied_at=TS, contract_completed_at=TS, terminal_at=TS,
    enrichment_status=STR, enrichment_stage=STR, enrichment_attempts=INT, detail_attempts=INT,
    next_retry_at=TS, fetched_at=TS, last_error=STR,
    lease_token=STR, leased_until=TS, current_batch_id=STR,
    latest_observation_id=STR, latest_observation_source=STR, latest_observed_at=TS,
    raw_payload=STR, created_at=TS, updated_at=TS,
)

ACTORS = _table(
    seq=LONG, github_id=LONG, login=STR, display_login=STR, name=STR, api_url=STR,
    avatar_url=STR, account_type=STR, **_LIFECYCLE)

REPOSITORIES = _table(
    seq=LONG, github_id=LONG, full_name=STR, name=STR, owner_login=STR, api_url=STR,
    description=STR, language=STR, owner_github_id=LONG, fork=BOOL, archived=BOOL,
    default_branch=STR, github_created_at=TS, **_LIFECYCLE)

OBSERVATIONS = _table(
    observation_id=STR, entity_kind=STR, entity_github_id=LONG, source=STR, observed_at=TS,
    raw_payload=STR, payload_fingerprint=STR, github_event_id=STR, request_batch_id=STR,
    requested_identifier=STR, validation_outcome=STR, created_at=TS, updated_at=TS,
)

BATCHES = _table(
    correlation_id=STR, request_kind=STR, entity_kind=STR, status=STR,
    requested_github_ids=T.ArrayType(LONG), requested_identifiers=T.ArrayType(STR),
    requested_count=INT, returned_count=INT, valid_count=INT, missing_count=INT,
    invalid_count=INT, total_count=INT, incomplete_results=BOOL, request_url=STR,
    response_status=INT, response_body=STR, rate_limit_resource=STR, rate_limit_limit=LONG,
    rate_limit_remaining=LONG, rate_limit_used=LONG, rate_limit_reset_at=TS, last_error=STR,
    started_at=TS, completed_at=TS, created_at=TS, updated_at=TS,
)

INGESTION_RUNS = _table(
    run_id=STR, source_id=LONG, status=STR, started_at=TS, completed_at=TS,
    pages_fetched=LONG, events_received=LONG, push_events_seen=LONG, events_created=LONG,
    duplicates_skipped=LONG, events_quarantined=LONG, events_failed=LONG, last_error=STR,
)

EVENT_SOURCES = _table(
    id=LONG, source_type=STR, enabled=BOOL, status=STR, consecutive_failures=INT, etag=STR,
    last_polled_at=TS, last_success_at=TS, cadence_due_at=TS, poll_floor_until=TS,
    retry_not_before_at=TS, next_poll_at=TS, last_error=STR,
)

CORE_BUDGET = _table(
    id=INT, resource=STR, window_status=STR, limit=LONG, remaining=LONG, reset_at=TS,
    observed_at=TS, window_initialized_at=TS, reserve=LONG, global_blocked_until=TS,
    poll_used=LONG, poll_allowance=LONG, enrichment_used=LONG, enrichment_allowance=LONG,
    actor_share_used=LONG, repository_share_used=LONG, consecutive_secondary_limits=INT,
)

SEARCH_BUDGET = _table(
    id=INT, resource=STR, limit=LONG, remaining=LONG, reset_at=TS, observed_at=TS,
    request_ceiling=LONG, reserve=LONG, used=LONG, actor_used=LONG, repository_used=LONG,
    blocked_until=TS, last_request_at=TS,
)

# What is kept of each run's walk between batches: where it ended, or the links it has followed.
WALKS = _table(
    run_id=STR, first_page=INT, first_class=STR, last_page=INT, counted_through=INT, stop_page=INT, stop_reason=STR,
    visited=T.ArrayType(_table(page_no=INT, next_key=STR)),
)

# Members of batches in flight, as they were when they were leased.
LEASES = _table(
    request_batch_id=STR, entity_kind=STR, seq=LONG, github_id=LONG, identifier=STR, api_url=STR, previous_stage=STR,
    enrichment_status=STR, enrichment_attempts=INT, detail_attempts=INT, lease_token=STR, leased_until=TS,
)

# Which runs a batch held pages of.
RUN_BATCHES = _table(run_id=STR, batch=LONG)

# Ids of stored events by hash bucket, and a Bloom filter of each bucket in words of 64 bits.
EVENT_IDS = _table(github_event_id=STR, id_bucket=INT)
ID_BLOOM = _table(id_bucket=INT, word=INT, bits=LONG)

TABLES = {
    "push_events": PUSH_EVENTS, "quarantined_events": QUARANTINED_EVENTS, "actors": ACTORS,
    "repositories": REPOSITORIES, "observations": OBSERVATIONS, "batches": BATCHES,
    "ingestion_runs": INGESTION_RUNS, "event_sources": EVENT_SOURCES,
    "core_budget": CORE_BUDGET, "search_budget": SEARCH_BUDGET,
    "walks": WALKS, "leases": LEASES, "run_batches": RUN_BATCHES, "event_ids": EVENT_IDS, "id_bloom": ID_BLOOM,
}

# How stored tables are laid out: the instant whose day makes a log's folders, further folder
# columns, and the key whose hash cuts a snapshot into buckets.
DAYS = {"push_events": "created_at", "observations": "observed_at"}
FOLDERS = {"observations": ("entity_kind",), "event_ids": ("id_bucket",)}
KEYS = {
    "quarantined_events": "payload_fingerprint", "actors": "github_id", "repositories": "github_id", "batches": "correlation_id",
    "ingestion_runs": "run_id", "event_sources": "id", "core_budget": "id", "search_budget": "id", "walks": "run_id",
    "leases": "request_batch_id", "id_bloom": "id_bucket",
}

ENTITY_TABLES = {"actor": ACTORS, "repository": REPOSITORIES}
IDENTITY_FIELDS = {
    "actor": ("login", "display_login", "api_url", "avatar_url"),
    "repository": ("full_name", "name", "owner_login", "api_url"),
}
IDENTIFIER = {"actor": "login", "repository": "full_name"}

# What makes each delivered element unique, in arrival order.
ARRIVAL = ("received_at", "run_id", "page_no", "pos")
