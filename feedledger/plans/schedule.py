"""When sources are polled next, and how healthy they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.functions.http import http_class, rate_limit_fields
from feedledger.functions.scalars import backoff, shift_seconds
from feedledger.sources.pages import with_array_flag

# The instants a poll waits for, in the order ties are named, and the cadence.
COMPONENTS = ("cadence_due_at", "poll_floor_until", "retry_not_before_at", "global_blocked_until",
              "poll_class_blocked_until")
FORCEABLE = ("cadence_due_at",)
POLL_INTERVAL_SECONDS = 300
DEFERRING_CLASSES = ("budget_denied", "gate_unavailable", "rate_limited", "secondary_limited")
UNATTEMPTED_CLASSES = ("budget_denied", "gate_unavailable")
SOURCE_FAILING_CLASSES = ("client_error", "not_found")


def source_schedule(sources: DataFrame, core_budget: DataFrame, now: Column, force: bool = False,
                    cadence: int = POLL_INTERVAL_SECONDS) -> DataFrame:
    """Per source: the five instants, the latest of them, which one binds, and whether it is due.

    A forced poll drops the cadence only. The budget is one row by its own rule.
    """
    blocked = F.when(F.col("poll_used") >= F.col("poll_allowance"),
                     F.coalesce("reset_at", shift_seconds(now, cadence)))
    budget = core_budget.where("id = 1").agg(
        F.max("global_blocked_until").alias("global_blocked_until"),
        F.max(blocked).alias("poll_class_blocked_until"))
    joined = sources.drop("next_poll_at").crossJoin(F.broadcast(budget))
    dropped = FORCEABLE if force else ()
    used = [F.when(F.lit(c not in dropped), F.col(c)) for c in COMPONENTS]
    effective = F.greatest(*used)
    binding = F.coalesce(*[F.when(value == F.col("next_poll_at"), F.lit(name))
                           for name, value in zip(COMPONENTS, used)])
    return (joined.withColumn("next_poll_at", effective)
            .withColumn("binding_component", binding)
            .withColumn("due_now", F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= now)))


def pollable(sources: DataFrame, source_type: str) -> DataFrame:
    return sources.where((F.col("source_type") == source_type) & F.col("enabled") & (F.col("status") == "idle"))


def poll_due(sources: DataFrame, source_type: str, now: Column) -> DataFrame:
    return pollable(sources, source_type).where(
        F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= now)).orderBy("id")


def run_log(pages: DataFrame) -> DataFrame:
    """One row per run from its first page: what was answered, and what the headers asked for.

    An answer that is no JSON array is a failure, whatever its status.
    """
    first = with_array_flag(pages.where("page_no = 1"))
    answer = http_class(F.col("status"), F.col("headers"))
    malformed = (answer == "ok") & ~F.col("is_array")
    quota = rate_limit_fields(F.col("headers"), F.col("received_at"))
    return first.select(
        "source_id", "run_id", F.col("received_at").alias("polled_at"),
        F.when(malformed, "malformed_page").otherwise(answer).alias("http_class"),
        quota["poll_interval_seconds"].alias("poll_interval_seconds"), quota["etag"].alias("etag"),
        quota["retry_after_seconds"].alias("retry_after_seconds"),
        F.lit(None).cast("string").alias("error_message"))


def source_health(log: DataFrame, cadence: int = POLL_INTERVAL_SECONDS, jitter: Column | None = None) -> DataFrame:
    """State of every source after all its runs.

    A success clears failures and the retry instant, a failure adds one and backs off, a
    permanent refusal takes the source out of service, a secondary limit moves only the
    retry instant, and other deferrals change nothing. All parts are aggregates: the last
    success per source is found first, then the failures after it are counted, so a source
    with most of the runs is still combined on the map side.
    """
    klass = F.col("http_class")
    kind = (F.when(klass.isin("ok", "not_modified"), "success")
            .when(klass.isin(*UNATTEMPTED_CLASSES), "skipped")
            .when(klass == "secondary_limited", "secondary")
            .when(klass.isin(*DEFERRING_CLASSES), "deferred")
            .when(klass.isin(*SOURCE_FAILING_CLASSES), "refused").otherwise("failure"))
    at = F.struct("polled_at", "run_id")
    runs = log.withColumn("_kind", kind)

    def last(value: Column | str, test: Column) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.max_by(value, F.when(test, at))

    seen = F.col("_kind")
    attempted = seen != "skipped"
    asked = F.col("retry_after_seconds").isNotNull()
    totals = runs.groupBy("source_id").agg(
        F.max(F.when(seen == "success", at)).alias("_success"),
        F.max(F.when(attempted, F.col("polled_at"))).alias("last_polled_at"),
        F.max(F.when(seen == "success", F.col("polled_at"))).alias("last_success_at"),
        F.max_by(F.struct(F.col("_kind").alias("kind"), F.col("polled_at").alias("at"),
                          F.col("retry_after_seconds").alias("after")),
                 F.when(seen.isin("success", "failure") | ((seen == "secondary") & asked), at)).alias("_retry"),
        F.max_by(F.struct(F.col("polled_at").alias("at"), F.col("poll_interval_seconds").alias("floor")),
                 F.when(attempted & (F.col("poll_interval_seconds") > 0), at)).alias("_floor"),
        last("etag", seen.isin("success") & F.col("etag").isNotNull()).alias("etag"),
        F.max_by(F.struct(F.when(seen != "success", F.coalesce("error_message", "http_class")).alias("text")),
                 F.when(seen.isin("success", "failure", "refused"), at)).alias("_error"),
        F.max(seen == "refused").alias("_refused"))
    successes = totals.select("source_id", "_success")
    failing = (runs.where("_kind = 'failure'").join(successes, "source_id")
               .where(F.col("_success").isNull() | (at > F.col("_success")))
               .groupBy("source_id").agg(F.count("*").alias("_failures")))
    joined = totals.join(failing, "source_id", "left")
    failures = F.coalesce("_failures", F.lit(0)).cast("int")
    retry = (F.when(F.col("_retry.kind") == "failure", shift_seconds(F.col("_retry.at"), backoff(failures, jitter=jitter)))
             .when(F.col("_retry.kind") == "secondary",
                   shift_seconds(F.col("_retry.at"), F.col("_retry.after"))))
    return joined.select(
        "source_id", F.when(F.col("_refused"), "failed").otherwise("idle").alias("status"),
        failures.alias("consecutive_failures"), "last_polled_at", "last_success_at",
        shift_seconds(F.col("last_polled_at"), cadence).alias("cadence_due_at"),
        shift_seconds(F.col("_floor.at"), F.col("_floor.floor")).alias("poll_floor_until"),
        retry.alias("retry_not_before_at"), "etag", F.col("_error.text").alias("last_error"))
