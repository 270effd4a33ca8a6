"""Reports on the state of the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.functions.http import rate_limit_fields
from feedledger.functions.scalars import age_seconds, pct, rate_per_hour, seconds_before, shift_seconds
from feedledger.operators.selection import ACTIVE_WITHIN_SECONDS, REFRESH_TTL_SECONDS
from feedledger.schemas import (
    BATCH_STATUSES, CANDIDATE_STATUSES, ENRICHMENT_STAGES, ENRICHMENT_STATUSES, ENTITY_KINDS,
    REQUEST_KINDS, SETTLED_STAGES, SUCCESSFUL_RUN_STATUSES,
)

# Default report windows and the sample below which no verdict is given.
COVERAGE_WINDOW_SECONDS = 86_400
METRICS_WINDOW_SECONDS = 3_600
MIN_SAMPLE_SECONDS = 900

_ITEM_SUMS = ("requested", "returned", "valid", "missing", "invalid")


def coverage(events: DataFrame, actors: DataFrame, repositories: DataFrame, now: Column,
             window: int = COVERAGE_WINDOW_SECONDS) -> DataFrame:
    """How much of the recent events' entities is complete; the window excludes its start.

    Events are counted per (actor, repository) before they meet the entities, so a pair
    seen a million times joins once.
    """
    pairs = (events.where(F.col("created_at") > seconds_before(now, window))
             .groupBy("github_actor_id", "github_repository_id").agg(F.count("*").alias("n")))

    def completeness(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col("github_id").alias(key), (F.col("enrichment_status") == "complete").alias(name))

    joined = (pairs.join(completeness(actors, "github_actor_id", "a"), "github_actor_id")
              .join(completeness(repositories, "github_repository_id", "r"), "github_repository_id"))

    def entities(key: str, complete: str, name: str) -> DataFrame:
        own = joined.groupBy(key).agg(F.max(complete).alias("done"))
        return own.agg(F.count(key).alias(f"{name}_count"), F.count_if("done").alias(f"complete_{name}_count"))

    events_seen = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"),
        F.coalesce(F.sum(F.when(F.col("a") & F.col("r"), F.col("n"))), F.lit(0)).alias("both_complete_event_count"))
    # Three frames of one row each.
    counts = (events_seen.crossJoin(entities("github_actor_id", "a", "actor"))
              .crossJoin(entities("github_repository_id", "r", "repository")))
    return counts.select(
        F.lit(window).alias("window_seconds"), seconds_before(now, window).alias("window_start"),
        "event_count", "actor_count", "complete_actor_count",
        pct(F.col("complete_actor_count"), F.col("actor_count")).alias("actor_coverage_pct"),
        "repository_count", "complete_repository_count",
        pct(F.col("complete_repository_count"), F.col("repository_count")).alias("repository_coverage_pct"),
        "both_complete_event_count",
        pct(F.col("both_complete_event_count"), F.col("event_count"))
        .alias("events_with_both_entities_enriched_pct"))


def in_contract_backlog() -> Column:
    return ~F.col("enrichment_stage").isin(*SETTLED_STAGES) & (F.col("enrichment_status") != "complete")


def backlog_metrics(kind: str, entities: DataFrame, now: Column,
                    window: int = METRICS_WINDOW_SECONDS) -> DataFrame:
    """One row of counts for one class, read in a single pass."""
    floor = seconds_before(now, window)
    status, stage = F.col("enrichment_status"), F.col("enrichment_stage")
    candidate = status.isin(*CANDIDATE_STATUSES)

    def count(test: Column) -> Column:
        return F.count_if(F.coalesce(test, F.lit(False)))

    row = entities.agg(
        *[count(status == s).alias(f"status_{s}") for s in ENRICHMENT_STATUSES],
        *[count(stage == s).alias(f"stage_{s}") for s in ENRICHMENT_STAGES],
        *[F.min(F.when(stage == s, F.col("created_at"))).alias(f"oldest_{s}") for s in ENRICHMENT_STAGES],
        count(candidate).alias("backlog_count"),
        F.min(F.when(candidate, F.col("created_at"))).alias("oldest_pending_at"),
        count(in_contract_backlog()).alias("contract_backlog_count"),
        count(F.col("created_at") > floor).alias("arrivals"),
        count(F.col("contract_completed_at") > floor).alias("completions"),
        count(F.col("terminal_at") > floor).alias("terminals"),
        F.min("created_at").alias("earliest_created_at"))
    return row.select(
        F.lit(kind).alias("entity_kind"), "*",
        age_seconds(F.col("oldest_pending_at"), now).alias("oldest_pending_age_seconds"))


def contract_backlog(entities: DataFrame) -> DataFrame:
    return entities.where(in_contract_backlog())


def batch_quality(batches: DataFrame, now: Column, window: int = METRICS_WINDOW_SECONDS) -> DataFrame:
    """Quality per request kind and class; the window includes its start, and all four
    groups are always there."""
    recent = batches.where(F.col("started_at") >= seconds_before(now, window))
    grouped = recent.groupBy("request_kind", "entity_kind").agg(
        F.count("*").alias("attempts"),
        *[F.count_if(F.col("status") == s).alias(s) for s in BATCH_STATUSES],
        *[F.sum(f"{c}_count").alias(f"{c}_items") for c in _ITEM_SUMS],
        F.count_if(F.coalesce("incomplete_results", F.lit(False))).alias("incomplete_results_count"))
    spark = batches.sparkSession
    domain = spark.createDataFrame([(r, e) for r in REQUEST_KINDS for e in ENTITY_KINDS],
                                   "request_kind string, entity_kind string")
    joined = F.broadcast(domain).join(grouped, ["request_kind", "entity_kind"], "left")
    zero = [c for c in grouped.columns if c not in ("request_kind", "entity_kind")]
    filled = joined.select("request_kind", "entity_kind",
                           *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zero])
    return filled.withColumn("fill_ratio", F.round(
        F.col("returned_items").cast("double") / F.nullif(F.col("requested_items"), F.lit(0)), 3))


def throughput(actor: DataFrame, repository: DataFrame, now: Column,
               window: int = METRICS_WINDOW_SECONDS, min_sample: int = MIN_SAMPLE_SECONDS) -> DataFrame:
    """Arrival and completion rates per lane and combined, and whether work keeps up.

    ``actor`` and ``repository`` are the one-row frames of ``backlog_metrics``.
    """
    used = ("arrivals", "completions", "terminals", "earliest_created_at", "contract_backlog_count")

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in used])

    both = side(actor, "actor").crossJoin(F.broadcast(side(repository, "repository")))
    for name in ("arrivals", "completions", "terminals", "contract_backlog_count"):
        both = both.withColumn(f"combined_{name}", F.col(f"actor_{name}") + F.col(f"repository_{name}"))
    start = seconds_before(now, window)
    earliest = F.least("actor_earliest_created_at", "repository_earliest_created_at")
    sampled = both.withColumn("sample_started_at", F.when(earliest.isNotNull(), F.greatest(start, earliest))) \
        .withColumn("sample_seconds", age_seconds(F.col("sample_started_at"), now))
    lanes = []
    for lane in ("actor", "repository", "combined"):
        arrivals, completions = F.col(f"{lane}_arrivals"), F.col(f"{lane}_completions")
        exits = completions + F.col(f"{lane}_terminals")
        lanes += [
            arrivals.alias(f"{lane}_arrivals"), completions.alias(f"{lane}_completions"),
            F.col(f"{lane}_terminals"), exits.alias(f"{lane}_exits"),
            rate_per_hour(arrivals, F.col("sample_seconds")).alias(f"{lane}_arrival_rate_per_hour"),
            rate_per_hour(completions, F.col("sample_seconds")).alias(f"{lane}_completion_rate_per_hour"),
            (arrivals - exits).alias(f"{lane}_backlog_delta")]
    rated = sampled.select("sample_started_at", "sample_seconds", "combined_contract_backlog_count", *lanes)
    return rated.select(
        F.lit(window).alias("window_seconds"), start.alias("window_start"), "sample_started_at",
        "sample_seconds", *[c for c in rated.columns if c.startswith(("actor_", "repository_"))],
        *[c for c in rated.columns if c.startswith("combined_") and c != "combined_contract_backlog_count"],
        catch_up_state(F.col("combined_backlog_delta"), F.col("combined_contract_backlog_count"),
                       F.col("sample_seconds"), min_sample).alias("catch_up_state"))


def catch_up_state(delta: Column, contract_backlog_count: Column, sample_seconds: Column,
                   min_sample: int = MIN_SAMPLE_SECONDS) -> Column:
    return (F.when(sample_seconds.isNull() | (sample_seconds < min_sample), "insufficient_sample")
            .when(delta < 0, "keeping_up")
            .when((delta == 0) & (contract_backlog_count == 0), "keeping_up")
            .otherwise("not_keeping_up"))


def latest_run_per_source(runs: DataFrame) -> DataFrame:
    """Newest finished run of every source; equal instants go to the higher run id."""
    finished = runs.where("completed_at IS NOT NULL")
    newest = F.max_by(F.struct("run_id", "status", "completed_at"), F.struct("completed_at", "run_id"))
    return finished.groupBy("source_id").agg(newest.alias("_run")).select("source_id", "_run.*")


def latest_successful_run(runs: DataFrame) -> DataFrame:
    return (runs.where(F.col("status").isin(*SUCCESSFUL_RUN_STATUSES) & F.col("completed_at").isNotNull())
            .orderBy(F.desc("completed_at"), F.desc("run_id")).limit(1))


def state_summary(runs: DataFrame, events: DataFrame, actors: DataFrame, repositories: DataFrame,
                  core_budget: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row: latest good run, stored events, pending entities, quota left, next poll.

    ``schedule`` is the result of ``source_schedule``; the first source speaks for all.
    """
    run = latest_successful_run(runs).agg(F.max("completed_at").alias("latest_run_at"),
                                          F.max("run_id").alias("latest_run_id"))
    stored = events.agg(F.count("*").alias("push_event_count"))

    def pending(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count_if(F.col("enrichment_status").isin(*CANDIDATE_STATUSES)).alias(name))

    budget = core_budget.where("id = 1").agg(
        F.max("resource").alias("budget_resource"), F.max("remaining").alias("budget_remaining"),
        F.max("reset_at").alias("budget_reset_at"), F.max("window_status").alias("window_status"),
        F.max("global_blocked_until").alias("global_blocked_until"))
    source = schedule.agg((F.count("*") > 0).alias("source_present"),
                          F.min_by(F.col("next_poll_at"), F.col("id")).alias("next_poll_at"))
    frames = [stored, pending(actors, "pending_actor_count"), pending(repositories, "pending_repository_count"),
              budget, source]
    joined = run
    for frame in frames:
        joined = joined.crossJoin(F.broadcast(frame))
    return joined


def quota_by_window(fetch_log: DataFrame, batches: DataFrame) -> DataFrame:
    """Per resource and reset instant: limit, least remaining, greatest used, our requests and
    what others used of the same quota."""
    seen = fetch_log.select(rate_limit_fields(F.col("headers"), F.col("received_at")).alias("q"))
    polls = seen.select(F.col("q.resource").alias("resource"), F.col("q.reset_at").alias("reset_at"),
                        F.col("q.limit").alias("limit"), F.col("q.remaining").alias("remaining"),
                        F.col("q.used").alias("used"), F.lit("poll").alias("origin"))
    lookups = batches.select(
        F.col("rate_limit_resource").alias("resource"), F.col("rate_limit_reset_at").alias("reset_at"),
        F.col("rate_limit_limit").cast("long").alias("limit"),
        F.col("rate_limit_remaining").cast("long").alias("remaining"),
        F.col("rate_limit_used").cast("long").alias("used"), F.lit("lookup").alias("origin"))
    known = polls.unionByName(lookups).where("resource IS NOT NULL AND reset_at IS NOT NULL")
    return known.groupBy("resource", "reset_at").agg(
        F.max("limit").alias("limit"), F.min("remaining").alias("least_remaining"),
        F.max("used").alias("greatest_used"), F.count_if(F.col("origin") == "poll").alias("polls"),
        F.count_if(F.col("origin") == "lookup").alias("lookups"),
    ).withColumn("used_by_others", F.greatest(
        F.col("greatest_used") - F.col("polls") - F.col("lookups"), F.lit(0)))


def next_due(actors: DataFrame, repositories: DataFrame, now: Column,
             ttl: int = REFRESH_TTL_SECONDS, active: int = ACTIVE_WITHIN_SECONDS) -> DataFrame:
    """The earliest instant at which an entity of either class becomes workable."""
    def earliest(df: DataFrame) -> DataFrame:
        refreshable = ((F.col("enrichment_status") == "complete")
                       & (F.col("enrichment_stage") == "contract_complete")
                       & (F.col("last_seen_at") >= seconds_before(now, active)))
        return df.agg(
            F.min(F.when((F.col("enrichment_stage") != "terminal") & (F.col("next_retry_at") >= now),
                         F.col("next_retry_at"))).alias("retry_at"),
            F.min(F.when(F.col("leased_until") >= now, F.col("leased_until"))).alias("lease_at"),
            F.min(F.when(refreshable, F.col("fetched_at"))).alias("oldest_fetch"))

    both = earliest(actors).unionByName(earliest(repositories)).agg(
        F.min("retry_at").alias("next_retry_at"), F.min("lease_at").alias("next_lease_expiry_at"),
        F.min("oldest_fetch").alias("_oldest"))
    refresh = F.when(F.col("_oldest").isNotNull(), F.greatest(shift_seconds(F.col("_oldest"), ttl), now))
    return both.select("next_retry_at", "next_lease_expiry_at", refresh.alias("next_refresh_at")).withColumn(
        "next_due_at", F.least("next_retry_at", "next_lease_expiry_at", "next_refresh_at"))


def table_counts(events: DataFrame, actors: DataFrame, repositories: DataFrame, quarantined: DataFrame,
                 runs: DataFrame) -> DataFrame:
    """Rows per table and occurrences in quarantine."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")

    frames = [rows(actors, "actors"), rows(repositories, "repositories"), rows(quarantined, "quarantined"),
              rows(runs, "runs"),
              quarantined.agg(F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("n"))
              .select(F.lit("occurrences").alias("measure"), "n")]
    counted = rows(events, "push_events")
    for frame in frames:
        counted = counted.unionByName(frame)
    return counted


def status_counts(actors: DataFrame, repositories: DataFrame) -> DataFrame:
    """Entities per class and status."""
    labelled = actors.select(F.lit("actor").alias("entity_kind"), "enrichment_status").unionByName(
        repositories.select(F.lit("repository").alias("entity_kind"), "enrichment_status"))
    return labelled.groupBy("entity_kind", "enrichment_status").agg(F.count("*").alias("n"))


# A state's words are sums of 60-bit pieces of row digests, held below this bound.
STATE_WORDS, WORD_BITS = 4, 60
_BOUND = 1 << WORD_BITS


def entity_state_sums(df: DataFrame, kind: str,
                      columns: tuple[str, ...] = ("first_seen_at", "last_seen_at", "latest_event_at")) -> DataFrame:
    """One row that stands for a multiset of entity rows: ``entities`` and four words.

    Words are sums of pieces of each row's SHA-256 modulo 2**60, so they depend on no order, are
    combined on the map side, and add up: the state of two sets of rows is the sum of theirs.
    """
    text = F.concat_ws("|", F.lit(kind), F.col("github_id").cast("string"), *[
        F.coalesce(F.unix_micros(c).cast("string") if dict(df.dtypes)[c] == "timestamp" else F.col(c).cast("string"), F.lit("~"))
        for c in columns])
    digits = WORD_BITS // 4
    rows = df.select(F.sha2(text, 256).alias("_digest"))
    words = [F.conv(F.substring("_digest", digits * k + 1, digits), 16, 10).cast("decimal(20,0)") for k in range(STATE_WORDS)]
    return rows.agg(F.count("*").alias("entities"), *[
        (F.coalesce(F.sum(w), F.lit(0).cast("decimal(30,0)")) % _BOUND).cast("long").alias(f"word_{k}") for k, w in enumerate(words)])


def changed_state(state: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The state after some rows have gone and others have come, from their sums alone."""
    signed = [df.select(F.lit(sign).alias("_sign"), "*") for df, sign in ((state, 1), (removed, -1), (added, 1))]
    both = reduce(DataFrame.unionByName, signed)
    total = [F.pmod(F.sum(F.col("_sign") * F.col(f"word_{k}").cast("decimal(20,0)")), F.lit(_BOUND)).cast("long").alias(f"word_{k}")
             for k in range(STATE_WORDS)]
    return both.agg(F.sum(F.col("_sign") * F.col("entities")).cast("long").alias("entities"), *total)


def state_digest(state: DataFrame) -> DataFrame:
    """``entities`` and one ``digest`` of a state's sums."""
    return state.select("entities", F.sha2(F.concat_ws(
        "|", *[F.col(c).cast("string") for c in ("entities", *(f"word_{k}" for k in range(STATE_WORDS)))]), 256).alias("digest"))


def entity_state_fingerprint(actors: DataFrame, repositories: DataFrame,
                             columns: tuple[str, ...] = ("first_seen_at", "last_seen_at", "latest_event_at"),
                             ) -> DataFrame:
    """One digest of all entity rows that does not depend on row order or placement."""
    both = [entity_state_sums(df, kind, columns) for df, kind in ((actors, "actor"), (repositories, "repository"))]
    nothing = both[0].select(*[F.lit(0).cast("long").alias(c) for c in both[0].columns])
    return state_digest(changed_state(both[0], nothing, both[1]))
