"""One-off repairs of older entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RETIRED_STATUS = "skipped_budget"


def backfill_stage(entities: DataFrame) -> DataFrame:
    """Stage and stage instants of rows that predate stages, from their status."""
    status, seen = F.col("enrichment_status"), F.coalesce("first_seen_at", "created_at")
    stage = (F.when(status == "complete", "contract_complete")
             .when(status == "permanent_failure", "terminal")
             .when(status == "retryable_failure", "retry_scheduled")
             .otherwise("batch_pending"))
    return entities.withColumns({
        "enrichment_stage": stage,
        "event_native_at": seen,
        "derived_at": seen,
        "batch_pending_at": F.when(status.isin("pending", "retryable_failure"), seen),
        "retry_scheduled_at": F.when(status == "retryable_failure", F.col("updated_at")),
        "contract_completed_at": F.when(status == "complete", F.col("fetched_at")),
        "terminal_at": F.when(status == "permanent_failure", F.col("updated_at")),
    })


def restore_retired_status(entities: DataFrame, now: Column) -> DataFrame:
    """Rows in the retired status become workable again; all others stay untouched."""
    retired = F.col("enrichment_status") == RETIRED_STATUS
    tried = (F.col("enrichment_attempts") > 0) | F.col("last_error").isNotNull()
    return entities.withColumns({
        "enrichment_status": F.when(retired, F.when(tried, "retryable_failure").otherwise("pending"))
        .otherwise(F.col("enrichment_status")),
        "next_retry_at": F.when(retired & (F.col("next_retry_at") > now), now)
        .otherwise(F.col("next_retry_at")),
        "updated_at": F.when(retired, F.greatest("updated_at", now)).otherwise(F.col("updated_at")),
    })
