"""Append-only evidence rows of created events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedledger.schemas import OBSERVATIONS


def observation_id(*parts):
    """A stable id from what makes the row unique, so a replay names it the same."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def event_observations(created: DataFrame) -> DataFrame:
    """Two rows per created event: the actor and the repository fragment it carried."""
    def fragment(kind: str, entity_id, text):
        return F.struct(F.lit(kind).alias("entity_kind"), entity_id.alias("entity_github_id"),
                        text.alias("raw_payload"))

    rows = created.select(
        "github_event_id", "received_at",
        F.inline(F.array(
            fragment("actor", F.col("push.github_actor_id"), F.col("actor_fragment")),
            fragment("repository", F.col("push.github_repository_id"), F.col("repo_fragment")))))
    return rows.select(
        observation_id(F.lit("event"), F.col("github_event_id"), F.col("entity_kind")).alias("observation_id"),
        "entity_kind", "entity_github_id", F.lit("event").alias("source"),
        F.col("received_at").alias("observed_at"), "raw_payload",
        F.sha2("raw_payload", 256).alias("payload_fingerprint"), "github_event_id",
        F.lit(None).cast("string").alias("request_batch_id"),
        F.lit(None).cast("string").alias("requested_identifier"),
        F.lit("event_native").alias("validation_outcome"),
        F.col("received_at").alias("created_at"), F.col("received_at").alias("updated_at"),
    ).select(*OBSERVATIONS.names)
