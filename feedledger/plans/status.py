"""The status document: every data block in one row, every key always present."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.functions.scalars import age_seconds, iso8601, shift_seconds
from feedledger.operators.selection import claimable
from feedledger.plans.reports import (
    COVERAGE_WINDOW_SECONDS, METRICS_WINDOW_SECONDS, backlog_metrics, batch_quality, coverage,
    latest_run_per_source, next_due, throughput,
)
from feedledger.plans.schedule import COMPONENTS, source_schedule
from feedledger.schemas import ENRICHMENT_STAGES, ENRICHMENT_STATUSES

DEFAULT_SHARE = Decimal("0.50")
SEARCH_PACING_SECONDS = 6



def sources_block(sources: DataFrame, runs: DataFrame, core_budget: DataFrame, now: Column) -> DataFrame:
    """One struct per source, in id order; sources are a handful of configured rows."""
    last = latest_run_per_source(runs).select(
        F.col("source_id").alias("id"), F.struct(
            "run_id", F.col("status").alias("status"), iso8601(F.col("completed_at")).alias("completed_at"))
        .alias("last_run"))
    planned = source_schedule(sources, core_budget, now).join(last, "id", "left")
    row = F.struct(
        "id", "source_type", "enabled", "status", "consecutive_failures",
        iso8601(F.col("last_polled_at")).alias("last_polled_at"),
        iso8601(F.col("last_success_at")).alias("last_success_at"), "due_now",
        iso8601(F.col("next_poll_at")).alias("next_poll_at"), "binding_component",
        F.struct(*[iso8601(F.col(c)).alias(c) for c in COMPONENTS]).alias("scheduling_components"), "last_run")
    return planned.agg(F.sort_array(F.collect_list(row)).alias("sources"))


def ledger_block(core_budget: DataFrame, share: Decimal | str = DEFAULT_SHARE) -> DataFrame:
    """The core quota ledger as stored, with each class's guarantee and what is left of it."""
    guarantee = F.floor(F.col("enrichment_allowance").cast("decimal(20,0)")
                        * F.lit(Decimal(str(share))).cast("decimal(10,8)")).cast("long")
    row = core_budget.where("id = 1").withColumns({
        "actor_guarantee": guarantee, "repository_guarantee": F.col("enrichment_allowance") - guarantee})

    def requests(kind: str) -> Column:
        used, due = F.col(f"{kind}_share_used"), F.col(f"{kind}_guarantee")
        return F.struct(used.alias("used"), due.alias("guarantee"),
                        F.greatest(due - used, F.lit(0).cast("long")).alias("available")).alias(f"{kind}_requests")

    shown = row.select(F.struct(
        F.lit(True).alias("present"), "resource", "window_status", "limit", "remaining",
        iso8601(F.col("reset_at")).alias("reset_at"), iso8601(F.col("observed_at")).alias("observed_at"),
        iso8601(F.col("window_initialized_at")).alias("window_initialized_at"), "reserve",
        iso8601(F.col("global_blocked_until")).alias("global_blocked_until"),
        F.struct(F.col("poll_used").alias("used"), F.col("poll_allowance").alias("allowance")).alias("poll"),
        F.struct(F.col("enrichment_used").alias("used"), F.col("enrichment_allowance").alias("allowance"))
        .alias("detail_fallback"), requests("actor"), requests("repository")).alias("ledger"))
    return _or_absent(shown, "ledger")


def search_ledger_block(search_budget: DataFrame, now: Column, pacing: int = SEARCH_PACING_SECONDS) -> DataFrame:
    """The search quota ledger as stored, what can be spent, and the earliest next request."""
    spendable = F.col("request_ceiling") - F.col("reserve")
    local = F.greatest(spendable - F.col("used"), F.lit(0).cast("long"))
    available = F.when(F.col("remaining").isNull(), local).otherwise(
        F.greatest(F.least(local, F.col("remaining") - F.col("reserve")), F.lit(0).cast("long")))
    earliest = F.greatest("blocked_until", shift_seconds(F.col("last_request_at"), pacing))
    shown = search_budget.where("id = 1").select(F.struct(
        F.lit(True).alias("present"), "resource", "limit", "remaining",
        iso8601(F.col("reset_at")).alias("reset_at"), iso8601(F.col("observed_at")).alias("observed_at"),
        "request_ceiling", "reserve", spendable.alias("spendable"), "used", "actor_used", "repository_used",
        available.alias("available"), iso8601(F.col("blocked_until")).alias("blocked_until"),
        iso8601(F.col("last_request_at")).alias("last_request_at"),
        iso8601(F.when(earliest > now, earliest)).alias("next_request_earliest_at")).alias("search_ledger"))
    return _or_absent(shown, "search_ledger")


def _or_absent(block: DataFrame, name: str) -> DataFrame:
    """A missing ledger still shows every key, all null but ``present``."""
    kind = block.schema[name].dataType
    empty = F.struct(*[(F.lit(False) if f.name == "present" else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in kind.fields])
    return block.agg(F.coalesce(F.max(F.col(name)), empty).alias(name))


def _entity_block(metrics: DataFrame, now: Column, name: str) -> DataFrame:
    stages = F.struct(*[F.struct(
        F.col(f"stage_{s}").alias("count"), iso8601(F.col(f"oldest_{s}")).alias("oldest_created_at"),
        age_seconds(F.col(f"oldest_{s}"), now).alias("oldest_age_seconds")).alias(s) for s in ENRICHMENT_STAGES])
    return metrics.select(F.struct(
        *[F.col(f"status_{s}").alias(s) for s in ENRICHMENT_STATUSES], "backlog_count",
        "contract_backlog_count", iso8601(F.col("oldest_pending_at")).alias("oldest_pending_at"),
        "oldest_pending_age_seconds", stages.alias("stages")).alias(name))


def _batches_block(batches: DataFrame, now: Column, window: int) -> DataFrame:
    quality = batch_quality(batches, now, window)
    measures = [c for c in quality.columns if c not in ("request_kind", "entity_kind")]

    def group(request: str, kind: str) -> Column:
        test = (F.col("request_kind") == request) & (F.col("entity_kind") == kind)
        return F.max(F.when(test, F.struct(*measures)))

    return quality.agg(*[group(r, e).alias(f"{r}_{e}") for r in ("search", "detail")
                         for e in ("actor", "repository")]).select(F.struct(
        F.lit(window).alias("window_seconds"),
        *[F.struct(F.col(f"{r}_actor").alias("actors"), F.col(f"{r}_repository").alias("repositories")).alias(r)
          for r in ("search", "detail")]).alias("batches"))


def _texts(df: DataFrame, name: str) -> DataFrame:
    """A one-row frame as one struct, its instants as report text."""
    return df.select(F.struct(*[
        (iso8601(F.col(f.name)) if f.dataType.typeName() == "timestamp" else F.col(f.name)).alias(f.name)
        for f in df.schema.fields]).alias(name))


def status_report(events: DataFrame, actors: DataFrame, repositories: DataFrame, batches: DataFrame,
                  runs: DataFrame, sources: DataFrame, core_budget: DataFrame, search_budget: DataFrame,
                  now: Column, metrics_window: int = METRICS_WINDOW_SECONDS,
                  coverage_window: int = COVERAGE_WINDOW_SECONDS) -> DataFrame:
    """One row with a struct per block. A null is a missing value, never a zero."""
    actor = backlog_metrics("actor", actors, now, metrics_window)
    repository = backlog_metrics("repository", repositories, now, metrics_window)
    work = claimable(actors, repositories, now).agg(
        F.max(F.col("batch_claimable") | F.col("has_detail")).alias("claimable_now"))
    upcoming = next_due(actors, repositories, now)
    frames = [
        sources_block(sources, runs, core_budget, now), ledger_block(core_budget),
        search_ledger_block(search_budget, now), _entity_block(actor, now, "actors"),
        _entity_block(repository, now, "repositories"), work, upcoming.select("next_due_at"),
        _batches_block(batches, now, metrics_window),
        _texts(throughput(actor, repository, now, metrics_window), "throughput"),
        _texts(coverage(events, actors, repositories, now, coverage_window), "coverage"),
    ]
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.crossJoin(F.broadcast(frame))
    enrichment = F.struct(
        "actors", "repositories", "claimable_now",
        iso8601(F.when(~F.col("claimable_now"), F.col("next_due_at"))).alias("next_enrichment_at"))
    return joined.select(
        iso8601(now).alias("captured_at"), "sources", "ledger", "search_ledger",
        enrichment.alias("enrichment"), "batches", "throughput", "coverage")


