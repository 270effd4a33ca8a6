"""What an answer does to batches and entities.

Every outcome is first written down as one row per lease; one join on (id, token, batch)
then moves the entity snapshot. An outcome whose token no longer matches moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from feedledger.functions.http import rate_limit_fields
from feedledger.functions.scalars import backoff, shift_seconds
from feedledger.operators.matching import (
    APPLIED, exploded_items, match_items, search_observation_id, unrequested_items, validate_details,
    validate_items,
)
from feedledger.operators.evidence import observation_id
from feedledger.schemas import ENTITY_TABLES
from feedledger.sources.documents import DEFERRED_CLASSES, answer_class

# Limits and reasons.
DETAIL_MAX_ATTEMPTS = 3
TERMINAL_CLASSES = ("not_found", "client_error", "permanent_error")
UNSEARCHABLE_SIGNAL = "cannot be searched"
COUNTS = ("requested_count", "returned_count", "valid_count", "missing_count", "invalid_count")

# How an entity moves: applied, fallback, retry, release, detail_applied, detail_retry,
# detail_terminal, detail_release.


def attribute_type(kind: str) -> T.StructType:
    names = (("account_type",) if kind == "actor" else
             ("description", "language", "owner_github_id", "owner_login", "fork", "archived",
              "default_branch", "github_created_at"))
    schema = ENTITY_TABLES[kind]
    return T.StructType([schema[n] for n in names])


def search_verdicts(documents: DataFrame) -> DataFrame:
    """One row per answered batch with its ``verdict``: ok, deferred, rejected, failed,
    malformed or abandoned, and the ``reason`` it is recorded with."""
    klass = answer_class()
    unsound = F.exists("items", lambda e: e["undefined"] | e["unstorable"])
    signal = F.coalesce(F.col("body").contains(UNSEARCHABLE_SIGNAL), F.lit(False))
    verdict = (
        F.when(klass.isin(*DEFERRED_CLASSES), "deferred")
        .when(klass == "client_error", "rejected")
        .when(klass != "ok", "failed")
        .when(F.col("document_error").isNotNull(), "malformed")
        .when(F.coalesce(unsound, F.lit(False)), "abandoned").otherwise("ok")
    )
    reason = (
        F.when(F.col("verdict") == "rejected",
               F.when(signal, "unsearchable_identifier").otherwise("search_query_rejected"))
        .when(F.col("verdict") == "malformed", F.col("document_error"))
        .when(F.col("verdict") == "abandoned", F.lit("payload cannot be recorded"))
        .when(F.col("verdict").isin("deferred", "failed"), F.coalesce("error_message", F.col("answer_class")))
    )
    return (documents.withColumn("answer_class", klass).withColumn("verdict", verdict)
            .withColumn("reason", reason))


def detail_verdicts(kind: str, leases: DataFrame, documents: DataFrame,
                    max_attempts: int = DETAIL_MAX_ATTEMPTS) -> DataFrame:
    """One row per detail lookup with verdict: completed, deferred, retry or terminal."""
    judged = validate_details(kind, leases.join(documents, "request_batch_id"))
    judged = judged.withColumn("answer_class", answer_class())
    klass, ok = F.col("answer_class"), F.col("answer_class") == "ok"
    last_try = F.col("detail_attempts") + 1 >= max_attempts
    verdict = (
        F.when(klass.isin(*DEFERRED_CLASSES), "deferred")
        .when(ok & (F.col("validation_outcome") == APPLIED), "completed")
        .when(~ok & klass.isin(*TERMINAL_CLASSES), "terminal")
        .when(last_try, "terminal").otherwise("retry")
    )
    plain = F.coalesce(F.col("transport_message"), klass)
    reason = (
        F.when(klass.isin(*DEFERRED_CLASSES), plain)
        .when(ok, F.col("document_message"))
        .when(klass == "not_found", F.concat(F.lit("entity_gone_"), F.col("status").cast("string")))
        .otherwise(plain)
    )
    return judged.withColumn("verdict", verdict).withColumn("reason", reason)


def _outcomes(df: DataFrame, kind: str, action: Column, reason: Column, observation: Column | None = None,
              attributes: Column | None = None, payload: Column | None = None) -> DataFrame:
    none = F.lit(None)
    shape = attribute_type(kind)
    return df.select(
        "request_batch_id", "github_id", "lease_token", action.alias("action"),
        reason.cast("string").alias("reason"), "previous_stage", "enrichment_status", "enrichment_attempts",
        "detail_attempts", (none if observation is None else observation).cast("string").alias("observation_id"),
        (none if attributes is None else attributes).cast(shape).alias("attributes"),
        (none if payload is None else payload).cast("string").alias("item_text"))


def match_answers(kind: str, leases: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged leases of well-formed answers, and the items nobody asked for."""
    ok = verdicts.where("verdict = 'ok'")
    items = exploded_items(ok)
    members = leases.join(ok.select("request_batch_id"), "request_batch_id", "left_semi")
    matched = match_items(kind, members, items)
    return validate_items(kind, matched), unrequested_items(items, matched)


def search_outcomes(kind: str, leases: DataFrame, verdicts: DataFrame, validated: DataFrame) -> DataFrame:
    """One row per lease of an answered batch: what happens to its entity and why."""
    outcome = F.col("validation_outcome")
    answered = _outcomes(
        validated, kind, F.when(outcome == APPLIED, "applied").otherwise("fallback"),
        F.when(F.col("pos").isNull(), "missing_search_result").when(outcome != APPLIED, outcome),
        F.when(F.col("pos").isNotNull(), search_observation_id(F.col("github_id"))),
        F.col("attributes"), F.col("item_text"))
    others = leases.join(
        verdicts.where("verdict <> 'ok'").select("request_batch_id", "verdict", "reason"), "request_batch_id")
    action = (F.when(F.col("verdict") == "rejected", "fallback")
              .when(F.col("verdict").isin("failed", "malformed"), "retry").otherwise("release"))
    return answered.unionByName(_outcomes(others, kind, action, F.col("reason")))


def detail_outcomes(kind: str, judged: DataFrame) -> DataFrame:
    action = (F.when(F.col("verdict") == "completed", "detail_applied")
              .when(F.col("verdict") == "deferred", "detail_release")
              .when(F.col("verdict") == "terminal", "detail_terminal").otherwise("detail_retry"))
    answered = F.col("answer_class") == "ok"
    return _outcomes(
        judged, kind, action, F.col("reason"),
        F.when(answered, observation_id(F.lit("detail"), F.col("request_batch_id"), F.col("github_id"))),
        F.col("attributes"), F.when(answered, F.col("kept_payload")))


def guard_lease(outcomes: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``lease_held``: the entity still carries the token and batch of the lease."""
    held = entities.where("lease_token IS NOT NULL").select(
        "github_id", "lease_token", F.col("current_batch_id").alias("request_batch_id"),
        F.lit(True).alias("_held"))
    return (outcomes.join(held, ["github_id", "lease_token", "request_batch_id"], "left")
            .withColumn("lease_held", F.coalesce("_held", F.lit(False))).drop("_held"))


def hold_leases(entities: DataFrame, leases: DataFrame, stage: str = "batch_in_flight") -> DataFrame:
    """Entities with the leases of a plan written on them."""
    held = leases.select("github_id", F.col("lease_token").alias("_t"), F.col("leased_until").alias("_u"),
                         F.col("request_batch_id").alias("_b"))
    joined = entities.join(held, "github_id", "left")
    taken = F.col("_t").isNotNull()
    return joined.withColumns({
        "enrichment_stage": F.when(taken, F.lit(stage)).otherwise(F.col("enrichment_stage")),
        "lease_token": F.when(taken, F.col("_t")).otherwise(F.col("lease_token")),
        "leased_until": F.when(taken, F.col("_u")).otherwise(F.col("leased_until")),
        "current_batch_id": F.when(taken, F.col("_b")).otherwise(F.col("current_batch_id")),
    }).select(*entities.columns)


def apply_outcomes(kind: str, entities: DataFrame, outcomes: DataFrame, now: Column,
                   jitter: Column | None = None) -> DataFrame:
    """The entity snapshot after a set of outcomes."""
    shape = attribute_type(kind)
    moves = outcomes.select(
        "github_id", F.col("lease_token").alias("_token"), F.col("request_batch_id").alias("_batch"),
        F.col("action").alias("_action"), F.col("reason").alias("_reason"),
        F.col("previous_stage").alias("_previous"), F.col("enrichment_attempts").alias("_attempts"),
        F.col("detail_attempts").alias("_details"), F.col("enrichment_status").alias("_status"),
        F.col("observation_id").alias("_observation"), F.col("attributes").alias("_attributes"),
        F.col("item_text").alias("_item"))
    joined = entities.join(
        moves.withColumnsRenamed({"_token": "lease_token", "_batch": "current_batch_id"}),
        ["github_id", "lease_token", "current_batch_id"], "left")

    def is_(*actions: str) -> Column:
        return F.coalesce(F.col("_action").isin(*actions), F.lit(False))

    def choose(column: str, *cases: tuple[Column, Column]) -> Column:
        chosen = F.when(cases[0][0], cases[0][1])
        for test, value in cases[1:]:
            chosen = chosen.when(test, value)
        return chosen.otherwise(F.col(column)).cast(entities.schema[column].dataType).alias(column)

    none = F.lit(None)
    moved = F.col("_action").isNotNull()
    done, detailed = is_("applied", "detail_applied"), is_("detail_applied")
    failed_detail = is_("detail_retry", "detail_terminal")
    complete = F.col("_status") == "complete"
    back = F.when(F.col("_previous").isNotNull() & (F.col("_previous") != "batch_in_flight"), F.col("_previous")) \
        .otherwise(F.when(complete, "contract_complete").otherwise("batch_pending"))
    tries = F.when(is_("retry"), F.col("_attempts")).otherwise(F.col("_details")) + 1
    retry_at = shift_seconds(now, backoff(tries, jitter=jitter))
    updates = {
        "enrichment_status": [
            (done, F.lit("complete")), (is_("detail_terminal"), F.lit("permanent_failure")),
            (is_("retry", "detail_retry"), F.when(complete, "complete").otherwise("retryable_failure"))],
        "enrichment_stage": [
            (done, F.lit("contract_complete")),
            (is_("fallback", "detail_release", "detail_retry"), F.lit("detail_pending")),
            (is_("retry"), F.when(complete, "contract_complete").otherwise("retry_scheduled")),
            (is_("detail_terminal"), F.lit("terminal")), (is_("release"), back)],
        "enrichment_attempts": [(done, F.lit(0)), (is_("retry") | failed_detail, F.col("_attempts") + 1)],
        "detail_attempts": [(detailed | failed_detail, F.col("_details") + 1)],
        "next_retry_at": [(done | is_("detail_terminal"), none), (is_("retry", "detail_retry"), retry_at)],
        "retry_scheduled_at": [(is_("detail_terminal"), none), (is_("retry", "detail_retry"), now)],
        "terminal_at": [(is_("detail_terminal"), now), (is_("detail_retry"), none)],
        "detail_pending_at": [(is_("fallback"), now)],
        "last_error": [(done, none), (is_("fallback"), F.col("_reason")),
                       (failed_detail, F.coalesce("_reason", F.lit("")))],
        "fetched_at": [(done, now)], "batch_applied_at": [(done, now)],
        "contract_completed_at": [(done, F.coalesce("contract_completed_at", now))],
        "latest_observation_id": [(done, F.col("_observation"))],
        "latest_observation_source": [(done, F.when(detailed, "detail").otherwise("search"))],
        "latest_observed_at": [(done, now)], "raw_payload": [(done, F.col("_item"))],
        "lease_token": [(moved, none)], "leased_until": [(moved, none)], "current_batch_id": [(moved, none)],
        "updated_at": [(moved, now)],
        **{name: [(done, F.col("_attributes")[name])] for name in shape.names},
    }
    return joined.select(*[choose(c, *updates[c]) if c in updates else F.col(c) for c in entities.columns])


def reclaim_stale(batches: DataFrame, claimed: DataFrame, now: Column) -> DataFrame:
    """In-flight batches one of whose members has been claimed again become stale."""
    left = (claimed.where("current_batch_id IS NOT NULL")
            .select(F.col("current_batch_id").alias("correlation_id")).distinct()
            .withColumn("_again", F.lit(True)))
    stale = F.coalesce(F.col("_again"), F.lit(False)) & (F.col("status") == "in_flight")
    return batches.join(left, "correlation_id", "left").withColumns({
        "status": F.when(stale, "stale_lease").otherwise(F.col("status")),
        "completed_at": F.when(stale, now).otherwise(F.col("completed_at")),
        "updated_at": F.when(stale, now).otherwise(F.col("updated_at")),
    }).select(*batches.columns)


def batch_results(guarded: DataFrame, verdicts: DataFrame, extras: DataFrame) -> DataFrame:
    """Per search batch: its result, and how many members and items went each way."""
    def tally(name: str, test: Column) -> Column:
        return F.count_if(test).alias(name)

    action, held = F.col("action"), F.col("lease_held")
    missing = (action == "fallback") & (F.col("reason") == "missing_search_result")
    members = guarded.groupBy("request_batch_id").agg(
        F.count("*").alias("members"), tally("applied", (action == "applied") & held),
        tally("lost", (action == "applied") & ~held), tally("missing", missing),
        tally("fallback_count", action == "fallback"))
    spare = extras.groupBy("request_batch_id").agg(F.count("*").alias("extra"))
    joined = (verdicts.join(members, "request_batch_id", "left").join(spare, "request_batch_id", "left"))
    verdict, ok = F.col("verdict"), F.col("verdict") == "ok"
    rejected_items = F.col("fallback_count") - F.col("missing")

    def number(when_ok: Column, otherwise: Column | None = None) -> Column:
        zero = F.lit(0)
        return F.coalesce(F.when(ok, when_ok).otherwise(zero if otherwise is None else otherwise), zero).cast("int")

    rejected = F.when(verdict == "rejected", F.coalesce("members", F.lit(0))).otherwise(F.lit(0))
    return joined.select(
        "request_batch_id", "verdict", "reason",
        F.when(ok | (verdict == "rejected"), "completed")
        .when(verdict == "deferred", "deferred").otherwise("failed").alias("result"),
        F.when(ok, "succeeded").when(verdict == "deferred", "deferred").otherwise("failed").alias("status"),
        F.coalesce("members", F.lit(0)).cast("int").alias("requested_count"),
        number(F.size("items")).alias("returned_count"), number(F.col("applied")).alias("valid_count"),
        number(F.col("missing"), rejected).alias("missing_count"),
        number(F.col("lost") + rejected_items + F.coalesce("extra", F.lit(0))).alias("invalid_count"),
        F.coalesce(F.when(ok | (verdict == "rejected"), F.col("fallback_count")), F.lit(0)).cast("int")
        .alias("fallback_count"),
        F.when(ok, F.col("total_count")).cast("int").alias("total_count"),
        F.when(ok, F.col("incomplete_results")).alias("incomplete_results"),
        F.col("status").alias("response_status"),
        F.when(F.col("answer_class") != "ok", F.coalesce("body", F.lit("")))
        .alias("response_body"),
        rate_limit_fields(F.col("headers"), F.col("received_at")).alias("quota"))


def detail_results(judged: DataFrame, guarded: DataFrame) -> DataFrame:
    """Per detail lookup: its result and counts."""
    held = guarded.select("request_batch_id", "lease_held")
    joined = judged.join(held, "request_batch_id", "left")
    verdict, completed = F.col("verdict"), F.col("verdict") == "completed"
    lost = completed & ~F.col("lease_held")
    failed = verdict.isin("retry", "terminal")
    return joined.select(
        "request_batch_id", "verdict", F.when(lost, "lease_lost").otherwise(F.col("reason")).alias("reason"),
        F.when(lost, "lease_lost").when(verdict == "retry", "retry_scheduled").otherwise(verdict).alias("result"),
        F.when(completed, "succeeded").when(verdict == "deferred", "deferred").otherwise("failed").alias("status"),
        F.lit(1).alias("requested_count"), completed.cast("int").alias("returned_count"),
        (completed & F.col("lease_held")).cast("int").alias("valid_count"), F.lit(0).alias("missing_count"),
        (failed | lost).cast("int").alias("invalid_count"), F.lit(0).alias("fallback_count"),
        F.lit(None).cast("int").alias("total_count"), F.lit(None).cast("boolean").alias("incomplete_results"),
        F.col("status").alias("response_status"),
        F.when(F.col("answer_class") != "ok", F.coalesce("body", F.lit("")))
        .alias("response_body"),
        rate_limit_fields(F.col("headers"), F.col("received_at")).alias("quota"))


def finalize_batches(batches: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Batch rows with their answers recorded; batches without one are left alone."""
    new = results.select(F.col("request_batch_id").alias("correlation_id"), *[
        F.col(c).alias(f"_{c}") for c in results.columns if c != "request_batch_id"])
    joined = batches.join(new, "correlation_id", "left")
    answered = F.col("_result").isNotNull()

    def then(column: str, value: Column) -> Column:
        return F.when(answered, value).otherwise(F.col(column)).cast(batches.schema[column].dataType).alias(column)

    clean = F.col("_status") == "succeeded"
    updates = {
        "status": F.col("_status"), "completed_at": now, "updated_at": now,
        "last_error": F.when(clean, F.col("last_error")).otherwise(F.col("_reason")),
        "response_status": F.col("_response_status"), "response_body": F.col("_response_body"),
        "total_count": F.col("_total_count"), "incomplete_results": F.col("_incomplete_results"),
        **{c: F.col(f"_{c}") for c in COUNTS[1:]},
        **{f"rate_limit_{f}": F.col(f"_quota.{f}") for f in ("resource", "limit", "remaining", "used", "reset_at")},
    }
    return joined.select(*[then(c, updates[c]) if c in updates else F.col(c) for c in batches.columns])


def enrich_tally(search: DataFrame, details: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counters over the results of a cycle; a result ``idle`` is a claim that found nothing."""
    shared = ("result", "requested_count", "valid_count", "fallback_count", *keys)
    both = search.select(F.lit(True).alias("batch"), *shared).unionByName(
        details.select(F.lit(False).alias("batch"), *shared))
    batch, result = F.col("batch"), F.col("result")

    def count(test: Column, name: str) -> Column:
        return F.count_if(test).cast("long").alias(name)

    def total(column: str, test: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0)).cast("long").alias(name)

    done = batch & (result == "completed")
    return both.groupBy(*keys).agg(
        count(result != "idle", "requests"), count(done, "batches_completed"),
        count(batch & (result == "failed"), "batches_failed"),
        total("requested_count", batch & result.isin("completed", "failed"), "items_requested"),
        total("valid_count", done, "items_valid"), total("fallback_count", done, "fallbacks_admitted"),
        count(~batch & (result == "completed"), "details_completed"),
        count(~batch & (result == "terminal"), "details_terminal"),
        count(~batch & (result == "retry_scheduled"), "details_retrying"),
        count(result == "deferred", "deferred"), count(result == "idle", "idle"),
        count(result == "lease_lost", "lease_lost"))
