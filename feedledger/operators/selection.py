"""Which entities are looked up next, and in which batches."""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedledger.functions.scalars import is_blank, seconds_before, shift_seconds
from feedledger.operators.ranking import global_rank
from feedledger.schemas import BATCHES, CANDIDATE_STATUSES, IDENTIFIER

# Stages each queue takes from, and default sizes.
BACKLOG_STAGES = ("batch_pending", "retry_scheduled", "batch_in_flight")
REFRESH_STAGES = ("contract_complete", "batch_in_flight")
DETAIL_STAGES = ("detail_pending", "detail_in_flight")
BATCH_SIZE = 10
REFRESH_TTL_SECONDS = 86_400
ACTIVE_WITHIN_SECONDS = 604_800
LEASE_SECONDS = 600


def _free(column: str, now: Column) -> Column:
    return F.col(column).isNull() | (F.col(column) <= now)


def is_due(now: Column) -> Column:
    return _free("leased_until", now) & _free("next_retry_at", now)


def is_backlog(now: Column) -> Column:
    return (is_due(now) & F.col("enrichment_status").isin(*CANDIDATE_STATUSES)
            & F.col("enrichment_stage").isin(*BACKLOG_STAGES))


def is_refresh_due(now: Column, ttl: int = REFRESH_TTL_SECONDS, active: int = ACTIVE_WITHIN_SECONDS) -> Column:
    return (is_due(now) & (F.col("enrichment_status") == "complete")
            & F.col("enrichment_stage").isin(*REFRESH_STAGES)
            & (F.col("fetched_at") <= seconds_before(now, ttl))
            & (F.col("last_seen_at") >= seconds_before(now, active)))


def is_detail_due(now: Column) -> Column:
    return (F.col("enrichment_stage").isin(*DETAIL_STAGES) & F.col("detail_pending_at").isNotNull()
            & is_due(now))


def due(entities: DataFrame, now: Column) -> DataFrame:
    return entities.where(is_due(now))


def backlog(entities: DataFrame, now: Column) -> DataFrame:
    return entities.where(is_backlog(now))


def refresh_due(entities: DataFrame, now: Column, **limits) -> DataFrame:
    return entities.where(is_refresh_due(now, **limits))


def detail_due(entities: DataFrame, now: Column) -> DataFrame:
    return entities.where(is_detail_due(now))


def claimable(actors: DataFrame, repositories: DataFrame, now: Column) -> DataFrame:
    """One row per class: has it backlog, refresh or detail work, and is a batch claimable.

    Refreshing counts as batch work only while no class has backlog.
    """
    def flags(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(
            (F.count_if(is_backlog(now)) > 0).alias("has_backlog"),
            (F.count_if(is_refresh_due(now)) > 0).alias("has_refresh"),
            (F.count_if(is_detail_due(now)) > 0).alias("has_detail"),
        ).select(F.lit(kind).alias("entity_kind"), "*")

    both = flags("actor", actors).unionByName(flags("repository", repositories))
    anywhere = both.agg(F.max("has_backlog").alias("any_backlog"))
    return both.crossJoin(F.broadcast(anywhere)).select(
        "entity_kind", "has_backlog", "has_refresh", "has_detail",
        (F.col("has_backlog") | (F.col("has_refresh") & ~F.col("any_backlog"))).alias("batch_claimable"))


def _candidate(kind: str, origin: str) -> list[Column]:
    return [F.lit(kind).alias("entity_kind"), F.lit(origin).alias("origin"), F.col("seq"), F.col("github_id"),
            F.col(IDENTIFIER[kind]).alias("identifier"), F.col("api_url"),
            F.col("enrichment_stage").alias("previous_stage"), F.col("enrichment_status"),
            F.col("enrichment_attempts"), F.col("detail_attempts"), F.col("current_batch_id")]


def select_batch(kind: str, entities: DataFrame, other: DataFrame, now: Column,
                 size: int = BATCH_SIZE) -> DataFrame:
    """The next batch of one class: its oldest backlog, or stale rows when no class has any."""
    first = (backlog(entities, now).orderBy("created_at", "seq").limit(size)
             .select(F.lit(0).alias("_lane"), F.col("created_at").alias("_at"), *_candidate(kind, "backlog")))
    waiting = entities.agg(F.count_if(is_backlog(now)).alias("n")).unionByName(
        other.agg(F.count_if(is_backlog(now)).alias("n"))).agg(F.sum("n").alias("_waiting"))
    # With no backlog anywhere the batch is empty so far, so all of it is spare.
    spare = (refresh_due(entities, now).orderBy("fetched_at", "seq").limit(size)
             .select(F.lit(1).alias("_lane"), F.col("fetched_at").alias("_at"), *_candidate(kind, "refresh"))
             .crossJoin(F.broadcast(waiting)).where("_waiting = 0").drop("_waiting"))
    # At most ``size`` rows are left to number.
    place = Window.orderBy("_lane", "_at", "seq")
    return (first.unionByName(spare).withColumn("position", F.row_number().over(place))
            .drop("_lane", "_at"))


def _named(kind: str) -> Column:
    refused = F.raise_error(F.concat(F.lit(f"{kind} "), F.col("github_id").cast("string"),
                                     F.lit(" has no search identifier"))).cast("string")
    return F.when(is_blank(F.col("identifier")), refused).otherwise(F.col("identifier"))


def batch_id_of(kind: str, request_kind: str, now: Column, number: Column) -> Column:
    """A stable id for a planned request, so planning twice names it the same."""
    return F.sha2(F.concat_ws("|", F.lit(request_kind), F.lit(kind), F.unix_micros(now).cast("string"),
                              number.cast("string")), 256)


def plan_members(kind: str, entities: DataFrame, now: Column, size: int = BATCH_SIZE) -> DataFrame:
    """Every backlog entity with its queue rank, batch number and batch id."""
    waiting = backlog(entities, now).select("created_at", *_candidate(kind, "backlog"))
    ranked = global_rank(waiting.withColumn("identifier", _named(kind)), ["created_at", "seq"])
    number = F.floor((F.col("rank") - 1) / F.lit(size)).cast("long")
    return (ranked.withColumn("batch_no", number)
            .withColumn("request_batch_id", batch_id_of(kind, "search", now, F.col("batch_no")))
            .withColumn("position", (F.col("rank") - F.col("batch_no") * size).cast("int")))


def plan_batches(kind: str, entities: DataFrame, now: Column, size: int = BATCH_SIZE) -> DataFrame:
    """The whole backlog as numbered first-in-first-out batches of at most ``size``."""
    members = plan_members(kind, entities, now, size)
    listed = members.groupBy("batch_no", "request_batch_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "github_id", "identifier"))).alias("_m"))
    return listed.select(
        "batch_no", "request_batch_id", F.lit(kind).alias("entity_kind"),
        F.col("_m.github_id").alias("requested_github_ids"),
        F.col("_m.identifier").alias("requested_identifiers"),
        F.size("_m").alias("requested_count"))


def plan_details(kind: str, entities: DataFrame, now: Column) -> DataFrame:
    """Every entity due for a lookup of its own, as a batch of one."""
    waiting = detail_due(entities, now).select(*_candidate(kind, "detail"))
    return waiting.withColumn("request_batch_id", batch_id_of(kind, "detail", now, F.col("github_id")))


def open_batches(members: DataFrame, request_kind: str, now: Column) -> DataFrame:
    """Batch rows, in flight, of planned members; a batch has at most ``size`` members."""
    listed = members.groupBy("request_batch_id", "entity_kind").agg(
        F.sort_array(F.collect_list(F.struct("seq", "github_id", "identifier"))).alias("_m"))
    known = {
        "correlation_id": F.col("request_batch_id"), "request_kind": F.lit(request_kind),
        "entity_kind": F.col("entity_kind"), "status": F.lit("in_flight"),
        "requested_github_ids": F.col("_m.github_id"), "requested_identifiers": F.col("_m.identifier"),
        "requested_count": F.size("_m"), "started_at": now, "created_at": now, "updated_at": now,
        **{f"{c}_count": F.lit(0) for c in ("returned", "valid", "missing", "invalid")},
    }
    return listed.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BATCHES.fields])


def leases_for(members: DataFrame, now: Column, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Members with the token and term under which an answer may change them."""
    return members.withColumns({
        "lease_token": F.sha2(F.concat(F.col("request_batch_id"), F.lit("|lease")), 256),
        "leased_until": shift_seconds(now, seconds)})


def split_allowance(allowance: int, share: str | Decimal) -> tuple[int, int]:
    """Guaranteed requests of actors and repositories; exact, so 0.29 of 100 is 29."""
    actor = int((Decimal(allowance) * Decimal(str(share))).to_integral_value(rounding=ROUND_FLOOR))
    return actor, allowance - actor


def share_quota(actors: DataFrame, repositories: DataFrame, allowance: int, share: str | Decimal,
                order: tuple[str, ...] = ("created_at", "seq")) -> DataFrame:
    """Rows of both queues that the allowance covers, oldest first in each class.

    A class first gets its guarantee; what one leaves over goes to the other. ``allowance``
    is a request quota. Positions come from a range sort, so no task holds a whole queue.
    """
    quotas = dict(zip(("actor", "repository"), split_allowance(allowance, share)))
    frames = {"actor": actors, "repository": repositories}
    counts = actors.agg(F.count("*").alias("_actor_n")).crossJoin(
        repositories.agg(F.count("*").alias("_repository_n")))

    def taken(kind: str, other: str) -> DataFrame:
        lent = F.greatest(F.lit(quotas[other]) - F.col(f"_{other}_n"), F.lit(0))
        numbered = global_rank(frames[kind], list(order), "position")
        return (numbered.crossJoin(F.broadcast(counts))
                .where(F.col("position") <= F.lit(quotas[kind]) + lent)
                .select(F.lit(kind).alias("entity_kind"), "github_id", "position",
                        (F.col("position") > quotas[kind]).alias("borrowed")))

    return taken("actor", "repository").unionByName(taken("repository", "actor"))
