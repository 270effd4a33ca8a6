"""Queries of section D: selection, matching, validation and stage transitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from feedledger.functions.scalars import iso8601, iso8601_micros, shift_seconds
from feedledger.operators import enrich_job, matching, selection, transitions
from feedledger.operators.ingest import SNAPSHOTS
from feedledger.session import shared_dir, stage
from feedledger.sources import documents
from feedledger.sources.tables import read_snapshot, swap_snapshot
from feedledger.workload import expected as X
from feedledger.workload import feed
from feedledger.workload.registry import query


def _actors(spark, sf_dir) -> DataFrame:
    return feed.entities(spark, sf_dir, "actor")


def _repositories(spark, sf_dir) -> DataFrame:
    return feed.entities(spark, sf_dir, "repository")


# --- selection ---------------------------------------------------------------------------


@query("d1_due", X.state(f"""
SELECT entity_kind, github_id FROM actor WHERE {X.DUE} UNION ALL SELECT entity_kind, github_id FROM repository WHERE {X.DUE}"""))
def d1(spark, sf_dir):
    return _both(spark, sf_dir, selection.due)


def _both(spark, sf_dir, operator) -> DataFrame:
    frames = [operator(feed.entities(spark, sf_dir, kind), feed.now()).select(
        F.lit(kind).alias("entity_kind"), "github_id") for kind in ("actor", "repository")]
    return frames[0].unionByName(frames[1])


def _both_sql(test: str) -> str:
    return X.state(f"SELECT entity_kind, github_id FROM actor WHERE {test} "
                   f"UNION ALL SELECT entity_kind, github_id FROM repository WHERE {test}")


@query("d2_backlog", _both_sql(X.BACKLOG))
def d2(spark, sf_dir):
    return _both(spark, sf_dir, selection.backlog)


@query("d3_refresh_due", _both_sql(X.REFRESH))
def d3(spark, sf_dir):
    return _both(spark, sf_dir, selection.refresh_due)


@query("d4_detail_due", _both_sql(X.DETAIL))
def d4(spark, sf_dir):
    return _both(spark, sf_dir, selection.detail_due)


@query("d5_select_batch", X.state(f"""
SELECT 'backlog' AS origin, github_id, identifier, CAST(row_number() OVER (ORDER BY created_at, seq) AS INTEGER) AS position
FROM repository WHERE {X.BACKLOG} QUALIFY position <= 10"""))
def d5(spark, sf_dir):
    return selection.select_batch("repository", _repositories(spark, sf_dir), _actors(spark, sf_dir), feed.now()).select(
        "origin", "github_id", "identifier", "position")


@query("d5_select_batch_refresh", X.state(f"""
SELECT 'refresh' AS origin, github_id, identifier, CAST(row_number() OVER (ORDER BY fetched_at, seq) AS INTEGER) AS position
FROM repository WHERE {X.REFRESH} QUALIFY position <= 10"""))
def d5_refresh(spark, sf_dir):
    idle = [df.where("enrichment_status NOT IN ('pending', 'retryable_failure')")
            for df in (_repositories(spark, sf_dir), _actors(spark, sf_dir))]
    return selection.select_batch("repository", *idle, feed.now()).select(
        "origin", "github_id", "identifier", "position")


@query("d6_plan_batches", X.state(f"""
, waiting AS (SELECT *, row_number() OVER (ORDER BY created_at, seq) AS rank FROM repository WHERE {X.BACKLOG})
SELECT (rank - 1) // 10 AS batch_no, CAST(count(*) AS INTEGER) AS requested_count,
  string_agg(CAST(github_id AS VARCHAR), ',' ORDER BY rank) AS ids, string_agg(identifier, ',' ORDER BY rank) AS identifiers
FROM waiting GROUP BY 1"""))
def d6(spark, sf_dir):
    plan = selection.plan_batches("repository", _repositories(spark, sf_dir), feed.now())
    return plan.select("batch_no", "requested_count",
                       F.array_join(F.col("requested_github_ids").cast("array<string>"), ",").alias("ids"),
                       F.array_join("requested_identifiers", ",").alias("identifiers"))


@query("d9_share_quota", X.state(f"""
, a AS (SELECT *, row_number() OVER (ORDER BY created_at, seq) AS p, count(*) OVER () AS total FROM actor WHERE {X.DETAIL}),
r AS (SELECT *, row_number() OVER (ORDER BY created_at, seq) AS p, count(*) OVER () AS total FROM repository WHERE {X.DETAIL}),
c AS (SELECT (SELECT count(*) FROM a) AS an, (SELECT count(*) FROM r) AS rn)
SELECT 'actor' AS entity_kind, github_id, CAST(p AS INTEGER) AS position, p > 29 AS borrowed FROM a, c WHERE p <= 29 + greatest(71 - rn, 0)
UNION ALL SELECT 'repository', github_id, CAST(p AS INTEGER), p > 71 FROM r, c WHERE p <= 71 + greatest(29 - an, 0)"""))
def d9(spark, sf_dir):
    due = [selection.detail_due(df, feed.now()) for df in (_actors(spark, sf_dir), _repositories(spark, sf_dir))]
    return selection.share_quota(*due, allowance=100, share="0.29")


@query("f4_exists_probe", X.state(f"""
, probes AS (SELECT 'actor' AS entity_kind, coalesce(bool_or({X.BACKLOG}), false) AS has_backlog, coalesce(bool_or({X.REFRESH}), false) AS has_refresh,
    coalesce(bool_or({X.DETAIL}), false) AS has_detail FROM actor
  UNION ALL SELECT 'repository', coalesce(bool_or({X.BACKLOG}), false), coalesce(bool_or({X.REFRESH}), false), coalesce(bool_or({X.DETAIL}), false) FROM repository)
SELECT *, has_backlog OR (has_refresh AND NOT (SELECT bool_or(has_backlog) FROM probes)) AS batch_claimable FROM probes"""))
def f4(spark, sf_dir):
    return selection.claimable(_actors(spark, sf_dir), _repositories(spark, sf_dir), feed.now())


# --- answers to batched lookups ----------------------------------------------------------


def _verdicts(spark, sf_dir, kind) -> DataFrame:
    answers = documents.search_documents(feed.search_answers(spark, sf_dir, kind))
    return stage(transitions.search_verdicts(answers), "verdicts")


def _judged(spark, sf_dir, kind):
    """Leases, verdicts, judged members and unrequested items of all answered batches."""
    leases = feed.members(spark, sf_dir, kind)
    verdicts = _verdicts(spark, sf_dir, kind)
    validated, extras = transitions.match_answers(kind, leases, verdicts)
    return leases, verdicts, stage(validated, "validated"), extras


@query("d10_match_items", X.lookups("actor", """
SELECT request_batch_id, g AS github_id, CAST(pos AS INTEGER) AS pos,
  CASE WHEN NOT returned THEN 'missing' WHEN g % 17 = 0 OR g % 19 = 0 THEN 'identifier' ELSE 'id' END AS matched_by
FROM m WHERE verdict = 'ok'"""))
def d10(spark, sf_dir):
    ok = _verdicts(spark, sf_dir, "actor").where("verdict = 'ok'")
    leases = feed.members(spark, sf_dir, "actor").join(ok.select("request_batch_id"), "request_batch_id", "left_semi")
    matched = matching.match_items("actor", leases, matching.exploded_items(ok))
    return matched.select("request_batch_id", "github_id", "pos", "matched_by")


@query("d10_unrequested_items", X.lookups("actor", """
SELECT DISTINCT request_batch_id, CAST(0 AS INTEGER) AS pos, '{"full_name":"no/body","id":77,"login":"nobody"}' AS text
FROM m WHERE verdict = 'ok' AND extra = 1"""))
def d10_extras(spark, sf_dir):
    return _judged(spark, sf_dir, "actor")[3].select("request_batch_id", "pos", "text")


@query("d11_validate_item", X.lookups("repository", """
SELECT request_batch_id, g AS github_id, outcome AS validation_outcome FROM j WHERE verdict = 'ok'"""))
def d11(spark, sf_dir):
    return _judged(spark, sf_dir, "repository")[2].select("request_batch_id", "github_id", "validation_outcome")


@query("d12_actor_contract", X.lookups("actor", """
SELECT g AS github_id, outcome AS validation_outcome, CASE WHEN outcome = 'applied' THEN 'User' END AS account_type
FROM j WHERE verdict = 'ok'"""))
def d12(spark, sf_dir):
    return _judged(spark, sf_dir, "actor")[2].select("github_id", "validation_outcome", "attributes.account_type")


@query("d13_repository_contract", X.lookups("repository", """
SELECT g AS github_id, CASE WHEN g % 3 <> 0 THEN 'a part' END AS description, 'SQL' AS language, g % 50 AS owner_github_id,
  'owner' || g % 50 AS owner_login, g % 2 = 0 AS fork, false AS archived, 'main' AS default_branch,
  '2011-01-26T19:01:12Z' AS github_created_at FROM j WHERE verdict = 'ok' AND outcome = 'applied'"""))
def d13(spark, sf_dir):
    applied = _judged(spark, sf_dir, "repository")[2].where("validation_outcome = 'applied'")
    return applied.select("github_id", "attributes.*").withColumn("github_created_at", iso8601(F.col("github_created_at")))


@query("d13_broken_rules", """
SELECT g AS github_id, CASE WHEN g % 11 = 0 THEN 'owner.id must be an integer' WHEN g % 17 = 0 THEN 'fork must be boolean'
  WHEN g % 19 = 0 THEN 'default_branch is not a non-empty string' WHEN g % 23 = 0 THEN 'description must be a string or null'
  WHEN g % 29 = 0 THEN 'created_at must be ISO-8601' END AS error FROM (SELECT CAST(p_partkey AS BIGINT) AS g FROM part)""")
def d13_rules(spark, sf_dir):
    asked = feed.members(spark, sf_dir, "repository").withColumn("g", F.col("github_id"))
    texts = asked.select("github_id", F.expr(feed.ITEM_SQL["repository"]).alias("text"), F.lit(False).alias("exact"))
    return matching.judge_documents("repository", texts, "text").select("github_id", F.col("contract_error").alias("error"))


def _details(spark, sf_dir):
    docs = documents.detail_documents(feed.detail_answers(spark, sf_dir, "actor"))
    return stage(transitions.detail_verdicts("actor", feed.detail_members(spark, sf_dir, "actor"), stage(docs, "documents")), "details")


@query("d14_document_identity", X.lookups("actor", """
SELECT g AS github_id, found AS validation_outcome, said AS message FROM y WHERE klass = 'ok'""", X.DETAILS))
def d14(spark, sf_dir):
    return _details(spark, sf_dir).where("answer_class = 'ok'").select(
        "github_id", "validation_outcome", F.col("document_message").alias("message"))


@query("d15_record_observations", X.lookups("actor", """
SELECT request_batch_id, outcome AS validation_outcome, count(*) AS n FROM j WHERE verdict = 'ok' AND returned GROUP BY 1, 2
UNION ALL SELECT request_batch_id, 'unrequested_result', 1 FROM (SELECT DISTINCT request_batch_id FROM m WHERE verdict = 'ok' AND extra = 1)"""))
def d15(spark, sf_dir):
    _, _, validated, extras = _judged(spark, sf_dir, "actor")
    rows = matching.record_observations("actor", validated, extras, feed.now())
    return rows.groupBy("request_batch_id", "validation_outcome").agg(F.count("*").alias("n"))


@query("d15_observation_fingerprints", X.lookups("actor", """
SELECT g AS entity_github_id, sha256('{' || CASE WHEN g % 17 = 0 THEN '"id":' || (g + 1000000000) || ',' WHEN g % 19 = 0 THEN '' ELSE '"id":' || g || ',' END
  || '"login":"' || CASE WHEN g % 7 = 0 THEN upper(identifier) ELSE identifier END || '"'
  || CASE WHEN b % 2 = 0 THEN ',"score":1.0' ELSE '' END || ',"type":"' || CASE WHEN g % 11 = 0 THEN ' ' ELSE 'User' END || '"}') AS payload_fingerprint
FROM j WHERE verdict = 'ok' AND returned"""))
def d15_fingerprints(spark, sf_dir):
    _, _, validated, extras = _judged(spark, sf_dir, "actor")
    rows = matching.record_observations("actor", validated, extras, feed.now())
    return rows.where("validation_outcome <> 'unrequested_result'").select("entity_github_id", "payload_fingerprint")


def _moved(spark, sf_dir, kind="actor") -> DataFrame:
    leases, verdicts, validated, _ = _judged(spark, sf_dir, kind)
    outcomes = transitions.search_outcomes(kind, leases, verdicts, validated)
    return transitions.apply_outcomes(kind, feed.leased_entities(spark, sf_dir, kind), outcomes, feed.now())


def _moved_sql(test: str, *columns: str) -> str:
    return X.lookups("actor", f"SELECT g AS github_id, {', '.join(columns)} FROM j WHERE held AND {test}")


@query("d16_apply_batch", _moved_sql(
    "verdict = 'ok' AND outcome = 'applied'", "'complete' AS enrichment_status", "'contract_complete' AS enrichment_stage",
    "CAST(0 AS INTEGER) AS enrichment_attempts", f"{X.micros(X.NOW_SQL)} AS fetched_at", f"{X.micros(X.NOW_SQL)} AS contract_completed_at",
    "'search' AS latest_observation_source", "'User' AS account_type", "CAST(NULL AS VARCHAR) AS lease_token"))
def d16(spark, sf_dir):
    return _moved(spark, sf_dir).where("latest_observation_source = 'search'").select(
        "github_id", "enrichment_status", "enrichment_stage", "enrichment_attempts",
        *[iso8601_micros(F.col(c)).alias(c) for c in ("fetched_at", "contract_completed_at")],
        "latest_observation_source", "account_type", "lease_token")


@query("d17_admit_fallback", _moved_sql(
    "(verdict = 'rejected' OR verdict = 'ok' AND coalesce(outcome, 'missing') <> 'applied')", "old_status AS enrichment_status",
    "CASE WHEN verdict = 'rejected' THEN 'unsearchable_identifier' ELSE coalesce(outcome, 'missing_search_result') END AS last_error",
    f"{X.micros(X.NOW_SQL)} AS detail_pending_at"))
def d17(spark, sf_dir):
    return _moved(spark, sf_dir).where("enrichment_stage = 'detail_pending'").select(
        "github_id", "enrichment_status", "last_error", iso8601_micros(F.col("detail_pending_at")).alias("detail_pending_at"))


@query("d18_fail_batch", _moved_sql(
    "verdict IN ('failed', 'malformed')", "CASE WHEN old_status = 'complete' THEN 'complete' ELSE 'retryable_failure' END AS enrichment_status",
    "CASE WHEN old_status = 'complete' THEN 'contract_complete' ELSE 'retry_scheduled' END AS enrichment_stage",
    "tries + 1 AS enrichment_attempts", f"{X.micros(f'{X.NOW_SQL} + to_seconds(60 * CAST(pow(2, tries) AS INTEGER))')} AS next_retry_at"))
def d18(spark, sf_dir):
    return _moved(spark, sf_dir).where("retry_scheduled_at IS NOT NULL").select(
        "github_id", "enrichment_status", "enrichment_stage", "enrichment_attempts",
        iso8601_micros(F.col("next_retry_at")).alias("next_retry_at"))


@query("d19_reject_batch", X.lookups("actor", """
SELECT request_batch_id, 'failed' AS status, 'unsearchable_identifier' AS reason, CAST(count(*) AS INTEGER) AS missing_count,
  CAST(0 AS INTEGER) AS returned_count FROM m WHERE verdict = 'rejected' GROUP BY 1"""))
def d19(spark, sf_dir):
    return _results(spark, sf_dir).where("verdict = 'rejected'").select(
        "request_batch_id", "status", "reason", "missing_count", "returned_count")


@query("d20_defer_batch", _moved_sql(
    "verdict = 'deferred'", "old_status AS enrichment_status", "'batch_pending' AS enrichment_stage", "tries AS enrichment_attempts",
    "CAST(NULL AS VARCHAR) AS lease_token"))
def d20(spark, sf_dir):
    return _moved(spark, sf_dir).where(
        "enrichment_stage = 'batch_pending' AND lease_token IS NULL").select(
        "github_id", "enrichment_status", "enrichment_stage", "enrichment_attempts", "lease_token")


@query("d21_apply_detail", X.lookups("actor", f"""
SELECT g AS github_id,
  CASE WHEN NOT held OR dv = 'deferred' THEN old_status WHEN dv = 'completed' THEN 'complete' WHEN dv = 'terminal' THEN 'permanent_failure'
       WHEN old_status = 'complete' THEN 'complete' ELSE 'retryable_failure' END AS enrichment_status,
  CASE WHEN NOT held THEN 'detail_in_flight' WHEN dv = 'completed' THEN 'contract_complete' WHEN dv = 'terminal' THEN 'terminal'
       ELSE 'detail_pending' END AS enrichment_stage,
  CASE WHEN NOT held OR dv = 'deferred' THEN tries ELSE tries + 1 END AS detail_attempts,
  CASE WHEN NOT held OR dv = 'deferred' THEN tries WHEN dv = 'completed' THEN 0 ELSE tries + 1 END AS enrichment_attempts,
  CASE WHEN held AND dv IN ('retry', 'terminal') THEN why END AS last_error,
  CASE WHEN held AND dv = 'retry' THEN {X.micros(f'{X.NOW_SQL} + to_seconds(60 * CAST(pow(2, tries) AS INTEGER))')} END AS next_retry_at
FROM y""", X.DETAILS))
def d21(spark, sf_dir):
    outcomes = transitions.detail_outcomes("actor", _details(spark, sf_dir))
    moved = transitions.apply_outcomes(
        "actor", feed.leased_entities(spark, sf_dir, "actor", detail=True), outcomes, feed.now())
    return moved.select("github_id", "enrichment_status", "enrichment_stage", "detail_attempts", "enrichment_attempts",
                        "last_error", iso8601_micros(F.col("next_retry_at")).alias("next_retry_at"))


@query("d22_reclaim_stale", X.state(f"""
, again AS (SELECT DISTINCT 'batch-' || g % 10 AS correlation_id FROM actor WHERE {X.BACKLOG} AND leased_until IS NOT NULL)
SELECT batches.correlation_id, CASE WHEN again.correlation_id IS NOT NULL AND status = 'in_flight' THEN 'stale_lease' ELSE status END AS status
FROM batches LEFT JOIN again USING (correlation_id)""", X.BATCHES))
def d22(spark, sf_dir):
    claimed = selection.backlog(_actors(spark, sf_dir), feed.now())
    return transitions.reclaim_stale(feed.batches(spark, sf_dir), claimed, feed.now()).select("correlation_id", "status")


def _guarded(spark, sf_dir):
    leases, verdicts, validated, extras = _judged(spark, sf_dir, "actor")
    outcomes = transitions.search_outcomes("actor", leases, verdicts, validated)
    return transitions.guard_lease(outcomes, feed.leased_entities(spark, sf_dir, "actor")), verdicts, extras


def _results(spark, sf_dir):
    return transitions.batch_results(*_guarded(spark, sf_dir))


@query("d23_guard_lease", X.lookups("actor", "SELECT g AS github_id, held AS lease_held FROM m"))
def d23(spark, sf_dir):
    return _guarded(spark, sf_dir)[0].select("github_id", "lease_held")


@query("d23_two_planners", X.state(f"""
SELECT 'actor' AS entity_kind, ceil(n / 10.0)::BIGINT AS batches, n AS leased, 0::BIGINT AS leased_again FROM (SELECT count(*) AS n FROM actor WHERE {X.BACKLOG})
UNION ALL SELECT 'repository', ceil(n / 10.0)::BIGINT, n, 0 FROM (SELECT count(*) AS n FROM repository WHERE {X.BACKLOG})"""))
def d23_two_planners(spark, sf_dir):
    """Plans made twice on stored tables: the second finds every due entity leased."""
    root = f"{shared_dir(spark).rstrip('/')}/planned-{uuid.uuid4().hex}"
    for batch, (kind, name) in enumerate(SNAPSHOTS.items()):
        swap_snapshot(feed.entities(spark, sf_dir, kind), root, name, batch)
    again = {}
    for kind in SNAPSHOTS:
        enrich_job.plan_enrichment(spark, root, kind, feed.now())
        again[kind] = enrich_job.plan_enrichment(spark, root, kind, feed.now()).first()["leased"]
    opened = read_snapshot(spark, root, "batches").groupBy("entity_kind").agg(F.count("*").alias("batches"))
    term = F.col("leased_until") == shift_seconds(feed.now(), selection.LEASE_SECONDS)
    held = [read_snapshot(spark, root, name).where(term & (F.col("enrichment_stage") == "batch_in_flight"))
            .join(read_snapshot(spark, root, "leases").select("github_id", "lease_token"), ["github_id", "lease_token"], "left_semi")
            .agg(F.lit(kind).alias("entity_kind"), F.count("*").alias("leased"), F.lit(again[kind]).cast("long").alias("leased_again"))
            for kind, name in SNAPSHOTS.items()]
    return opened.join(held[0].unionByName(held[1]), "entity_kind").select("entity_kind", "batches", "leased", "leased_again")


_RESULTS = """
results AS (SELECT request_batch_id, verdict,
  CASE WHEN verdict IN ('ok', 'rejected') THEN 'completed' WHEN verdict = 'deferred' THEN 'deferred' ELSE 'failed' END AS result,
  CASE WHEN verdict = 'ok' THEN 'succeeded' WHEN verdict = 'deferred' THEN 'deferred' ELSE 'failed' END AS status,
  count(*) AS requested,
  CASE WHEN verdict = 'ok' THEN count(*) FILTER (WHERE returned) + max(extra) ELSE 0 END AS returned_n,
  CASE WHEN verdict = 'ok' THEN count(*) FILTER (WHERE outcome = 'applied' AND held) ELSE 0 END AS valid,
  CASE WHEN verdict = 'ok' THEN count(*) FILTER (WHERE NOT returned) WHEN verdict = 'rejected' THEN count(*) ELSE 0 END AS missing,
  CASE WHEN verdict = 'ok' THEN count(*) FILTER (WHERE returned AND (outcome <> 'applied' OR NOT held)) + max(extra) ELSE 0 END AS invalid,
  CASE WHEN verdict = 'ok' THEN count(*) FILTER (WHERE coalesce(outcome, '') <> 'applied') WHEN verdict = 'rejected' THEN count(*) ELSE 0 END AS fallback,
  any_value(b) AS b FROM j GROUP BY request_batch_id, verdict)"""


@query("d24_finalize_batch", X.lookups("actor", """
SELECT request_batch_id AS correlation_id, status, CAST(returned_n AS INTEGER) AS returned_count, CAST(valid AS INTEGER) AS valid_count,
  CAST(missing AS INTEGER) AS missing_count, CAST(invalid AS INTEGER) AS invalid_count,
  CASE WHEN verdict = 'ok' THEN b % 6 = 0 END AS incomplete_results,
  CASE verdict WHEN 'rejected' THEN 422 WHEN 'failed' THEN 503 WHEN 'deferred' THEN 403 ELSE 200 END AS response_status,
  verdict IN ('rejected', 'failed', 'deferred') AS body_kept, 'search' AS rate_limit_resource FROM results""", _RESULTS))
def d24(spark, sf_dir):
    done = transitions.finalize_batches(feed.open_batches(spark, sf_dir, "actor"), _results(spark, sf_dir), feed.now())
    return done.select("correlation_id", "status", "returned_count", "valid_count", "missing_count", "invalid_count",
                       "incomplete_results", "response_status", F.col("response_body").isNotNull().alias("body_kept"),
                       "rate_limit_resource")


@query("d25_enrich_tally", X.lookups("actor", """
SELECT (SELECT count(*) FROM results) + (SELECT count(*) FROM y) AS requests,
  (SELECT count(*) FROM results WHERE result = 'completed') AS batches_completed,
  (SELECT count(*) FROM results WHERE result = 'failed') AS batches_failed,
  (SELECT CAST(sum(requested) AS BIGINT) FROM results WHERE result <> 'deferred') AS items_requested,
  (SELECT CAST(sum(valid) AS BIGINT) FROM results) AS items_valid, (SELECT CAST(sum(fallback) AS BIGINT) FROM results) AS fallbacks_admitted,
  (SELECT count(*) FROM y WHERE dv = 'completed' AND held) AS details_completed, (SELECT count(*) FROM y WHERE dv = 'terminal') AS details_terminal,
  (SELECT count(*) FROM y WHERE dv = 'retry') AS details_retrying,
  (SELECT count(*) FROM results WHERE result = 'deferred') + (SELECT count(*) FROM y WHERE dv = 'deferred') AS deferred,
  CAST(0 AS BIGINT) AS idle, (SELECT count(*) FROM y WHERE dv = 'completed' AND NOT held) AS lease_lost""", _RESULTS, X.DETAILS))
def d25(spark, sf_dir):
    judged = _details(spark, sf_dir)
    guarded = transitions.guard_lease(transitions.detail_outcomes("actor", judged),
                                      feed.leased_entities(spark, sf_dir, "actor", detail=True))
    return transitions.enrich_tally(_results(spark, sf_dir), transitions.detail_results(judged, guarded))
