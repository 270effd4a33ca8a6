"""Stored tables one at a time, reports and rule checks (A9 to A12); ``commits`` writes several at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedledger import schemas as S
from feedledger.sources.commits import Transaction, read_manifest, table_rows

# --- one table at a time -------------------------------------------------------------------


def append_log(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Adds the batch's rows; writing the newest batch again replaces them as a whole.

    The rows become visible by one manifest, so a reader meets the earlier attempt's rows or
    these, never neither. A batch older than the newest is refused.
    """
    tx = Transaction(df.sparkSession, root, batch_id)
    tx.append(df, table, again=True)
    tx.commit()


def read_log(spark: SparkSession, root: str, table: str, before: int | None = None,
             since: Column | None = None) -> DataFrame:
    """Rows of the live parts, of earlier batches only when a batch is being worked on.

    A replayed batch must not meet its own rows, or it would take them for duplicates.
    ``since`` opens only the folders of that day and later; the day itself comes whole.
    """
    return table_rows(spark, root, read_manifest(spark, root), table, before=before, since=since)


def swap_snapshot(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Write the next version beside the live one, then commit it."""
    tx = Transaction(df.sparkSession, root, batch_id)
    tx.replace(df, table)
    tx.commit()


def read_snapshot(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    """The live version, or the one that was live before batch ``before`` was committed."""
    return table_rows(spark, root, read_manifest(spark, root, before), table)


# --- reports -----------------------------------------------------------------------------


def write_report(df: DataFrame, path: str) -> None:
    """JSON rows with every key present, null ones included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# --- rules -------------------------------------------------------------------------------

# Rules of the stored tables, whose columns and names are given.
_COUNTERS = {
    "batches": ("requested_count", "returned_count", "valid_count", "missing_count", "invalid_count"),
    "event_sources": ("consecutive_failures",),
    "actors": ("enrichment_attempts", "detail_attempts"),
    "repositories": ("enrichment_attempts", "detail_attempts"),
    "ingestion_runs": ("pages_fetched", "events_received", "push_events_seen", "events_created",
                       "duplicates_skipped", "events_quarantined", "events_failed"),
    "core_budget": ("poll_allowance", "poll_used", "enrichment_allowance", "enrichment_used",
                    "actor_share_used", "repository_share_used", "reserve", "limit", "remaining",
                    "consecutive_secondary_limits"),
    "search_budget": ("reserve", "used", "actor_used", "repository_used", "limit", "remaining"),
}
_DOMAINS = {
    "batches": {"entity_kind": S.ENTITY_KINDS, "request_kind": S.REQUEST_KINDS, "status": S.BATCH_STATUSES},
    "observations": {"entity_kind": S.ENTITY_KINDS, "source": S.OBSERVATION_SOURCES},
    "event_sources": {"status": S.SOURCE_STATUSES},
    "actors": {"enrichment_status": S.ENRICHMENT_STATUSES, "enrichment_stage": S.ENRICHMENT_STAGES},
    "repositories": {"enrichment_status": S.ENRICHMENT_STATUSES, "enrichment_stage": S.ENRICHMENT_STAGES},
    "ingestion_runs": {"status": S.RUN_STATUSES},
    "core_budget": {"window_status": S.WINDOW_STATUSES},
}
_UNIQUE = {
    "push_events": "github_event_id", "quarantined_events": "payload_fingerprint",
    "actors": "github_id", "repositories": "github_id", "batches": "correlation_id",
    "ingestion_runs": "run_id",
}
_REQUIRED = {
    "push_events": ("github_event_id", "github_push_id", "github_repository_id", "github_actor_id", "ref",
                    "head_sha", "before_sha", "occurred_at", "raw_payload", "created_at"),
    "quarantined_events": ("payload_fingerprint", "first_received_at", "last_received_at"),
    "actors": ("github_id", "login", "created_at", "updated_at"),
    "repositories": ("github_id", "full_name", "created_at", "updated_at"),
    "observations": ("entity_kind", "source", "observed_at", "raw_payload", "payload_fingerprint",
                     "validation_outcome"),
    "batches": ("correlation_id", "request_kind", "entity_kind", "status", "started_at"),
    "ingestion_runs": ("run_id", "status", "started_at"),
    "event_sources": ("source_type", "status"),
}
_SINGLETONS = ("core_budget", "search_budget")
# Child table and column, parent table and column.
_REFERENCES = (
    ("push_events", "github_actor_id", "actors", "github_id"),
    ("push_events", "github_repository_id", "repositories", "github_id"),
    ("observations", "github_event_id", "push_events", "github_event_id"),
    ("observations", "request_batch_id", "batches", "correlation_id"),
    ("actors", "current_batch_id", "batches", "correlation_id"),
    ("repositories", "current_batch_id", "batches", "correlation_id"),
    ("actors", "latest_observation_id", "observations", "observation_id"),
    ("repositories", "latest_observation_id", "observations", "observation_id"),
    ("ingestion_runs", "source_id", "event_sources", "id"),
)


def row_rules(table: str) -> dict[str, Column]:
    """Rule name to the condition that breaks it, for rules one row can break alone."""
    rules: dict[str, Column] = {}
    for name in _REQUIRED.get(table, ()):
        rules[f"{name}_present"] = F.col(name).isNull()
    for name in _COUNTERS.get(table, ()):
        rules[f"{name}_nonnegative"] = F.coalesce(F.col(name) < 0, F.lit(False))
    for name, domain in _DOMAINS.get(table, {}).items():
        rules[f"{name}_known"] = F.coalesce(~F.col(name).isin(*domain), F.lit(False))
    if table in _SINGLETONS:
        rules["singleton"] = F.col("id") != 1
    if table == "search_budget":
        rules["request_ceiling_positive"] = F.col("request_ceiling") <= 0
    if table == "quarantined_events":
        rules["occurrence_count_positive"] = F.col("occurrence_count") < 1
    return rules


def _row_key(table: str, df: DataFrame) -> Column:
    for name in (_UNIQUE.get(table), "observation_id", "id"):
        if name and name in df.columns:
            return F.col(name).cast("string")
    return F.lit(None).cast("string")


def check_constraints(df: DataFrame, table: str, related: dict[str, DataFrame] | None = None) -> DataFrame:
    """Broken rules as ``(table_name, rule, row_key)``: one row per row and rule, one per
    repeated key, one per child row without its parent."""
    rules = row_rules(table)
    key = _row_key(table, df)
    found = []
    if rules:
        broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
        found.append(df.select(F.explode(broken).alias("rule"), key.alias("row_key")))
    if table in _UNIQUE:
        name = _UNIQUE[table]
        found.append(df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
                     .where("_n > 1").select(F.lit(f"{name}_unique").alias("rule"),
                                             F.col(name).cast("string").alias("row_key")))
    for child, column, parent, target in _REFERENCES:
        if child == table and related and parent in related:
            parents = related[parent].select(F.col(target).alias(column))
            found.append(df.where(F.col(column).isNotNull()).join(parents, column, "left_anti")
                         .select(F.lit(f"{column}_references_{parent}").alias("rule"), key.alias("row_key")))
    if not found:
        return df.sparkSession.createDataFrame([], "table_name string, rule string, row_key string")
    return reduce(DataFrame.unionByName, found).select(F.lit(table).alias("table_name"), "rule", "row_key")
