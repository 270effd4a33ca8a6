"""Queries of sections E, F, G and H: scalar functions, listings, reports and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from feedledger.functions import scalars as S
from feedledger.functions.cursors import decode_cursor, encode_cursor
from feedledger.functions.http import http_class, rate_limit_fields, url_violations
from feedledger.functions.json_values import json_type
from feedledger.operators.dedup import dedup_new, delivery_results, run_tally, tally_identities
from feedledger.operators.ingest import ingest_batch
from feedledger.plans import listings, reports, schedule
from feedledger.plans.status import status_report
from feedledger.session import DENSE, discard, freed_shuffles, shared_dir, stage
from feedledger.sources.pages import page_state, read_fetch_log
from feedledger.sources.tables import read_log, read_snapshot
from feedledger.streaming.ingest import ingest_and_report_stream, ingest_stream
from feedledger.streaming.stateful import fold_stream
from feedledger.workload import expected as X
from feedledger.workload import feed
from feedledger.workload.ingest_queries import MERGE_COLUMNS, RESULT_COLUMNS, landed
from feedledger.workload.registry import query

_us = S.iso8601_micros


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _entities(spark, sf_dir):
    return feed.entities(spark, sf_dir, "actor"), feed.entities(spark, sf_dir, "repository")




# --- E -----------------------------------------------------------------------------------


@query("e1_json_type", """
SELECT event_id, ['object','array','string','integer','float','boolean','null','absent'][CAST(event_id % 8 AS INTEGER) + 1] AS kind FROM events""")
def e1(spark, sf_dir):
    n = F.col("n")
    value = F.coalesce(*[F.when(n % 8 == i, F.lit(text)) for i, text in enumerate(
        ['{"a":{}}', '{"a":[1]}', '{"a":"1"}', '{"a":9223372036854775808}', '{"a":1.0}', '{"a":true}', '{"a":null}', '{"b":1}'])])
    rows = feed.events(spark, sf_dir).select(n.alias("event_id"), value.alias("text"))
    found = F.try_variant_get(F.try_parse_json("text"), "$.a", "variant")
    token = F.regexp_extract("text", r':(-?\d[\d.eE+-]*)\}', 1)
    return rows.select("event_id", json_type(found, token).alias("kind"))


@query("e2_is_blank", """
SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank,
       trim(replace(text, lower(text), ''), ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank_left FROM documents""")
def e2(spark, sf_dir):
    left = F.replace(F.col("text"), F.lower("text"), F.lit(""))  # whole texts, blank where they are lower case already
    return feed.table(spark, sf_dir, "documents").select(
        "doc_id", S.is_blank(F.col("text")).alias("blank"), S.is_blank(left).alias("blank_left"))


@query("e3_iso8601_utc", f"SELECT event_id, {X.iso('ts')} AS seconds, {X.micros('ts')} AS micros FROM events")
def e3(spark, sf_dir):
    return feed.events(spark, sf_dir).select(F.col("n").alias("event_id"), S.iso8601(F.col("ts")).alias("seconds"),
                                             _us(F.col("ts")).alias("micros"))


_CURSOR = """rtrim(replace(replace(to_base64(encode({0} || '|' || (event_id + 1))), '+', '-'), '/', '_'), '=')"""


@query("e4_cursor", f"""
SELECT event_id, {_CURSOR.format(X.micros('ts'))} AS encoded, {X.micros('ts')} AS occurred_at, event_id + 1 AS seq FROM events""")
def e4(spark, sf_dir):
    rows = feed.events(spark, sf_dir).select("n", encode_cursor(F.col("ts"), F.col("n") + 1).alias("encoded"))
    back = rows.select("n", "encoded", decode_cursor(F.col("encoded")).alias("c"))
    return back.select(F.col("n").alias("event_id"), "encoded", _us(F.col("c.occurred_at")).alias("occurred_at"), "c.seq")


@query("e5_casecmp", "SELECT c_custkey, translate(c_name || 'ÀÉ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM customer")
def e5(spark, sf_dir):
    return feed.table(spark, sf_dir, "customer").select(
        "c_custkey", S.casefold_ascii(F.concat("c_name", F.lit("ÀÉ"))).alias("folded"))


@query("e6_pct", """
SELECT user_id, CASE WHEN big = 0 THEN NULL ELSE round(CAST(100.0 * CAST(both_n AS DOUBLE) / big AS DOUBLE), 2) END AS pct
FROM (SELECT user_id, count(*) FILTER (WHERE value > 50) AS big, count(*) FILTER (WHERE value > 100) AS both_n FROM events GROUP BY 1)""")
def e6(spark, sf_dir):
    counts = feed.events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(F.col("value") > 50).alias("big"), F.count_if(F.col("value") > 100).alias("both_n"))
    return counts.select("user_id", S.pct(F.col("both_n"), F.col("big")).alias("pct"))


@query("e7_backoff", "SELECT event_id, least(60.0 * pow(2, greatest(event_id % 9, 1) - 1), 3600.0) AS delay FROM events")
def e7(spark, sf_dir):
    return feed.events(spark, sf_dir).select(F.col("n").alias("event_id"), S.backoff(F.col("n") % 9).alias("delay"))


@query("e8_rate_per_hour", """
SELECT user_id, CASE WHEN s = 0 THEN NULL ELSE round(n * 3600.0::DOUBLE / s, 2) END AS rate
FROM (SELECT user_id, count(*) AS n, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS s FROM (
  SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1)""")
def e8(spark, sf_dir):
    spans = feed.events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("s"))
    return spans.select("user_id", S.rate_per_hour(F.col("n"), F.col("s")).alias("rate"))


@query("e9_age_seconds", f"""
SELECT event_id, greatest(CAST(floor((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 1000000.0) AS BIGINT), 0) AS age FROM events""")
def e9(spark, sf_dir):
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return feed.events(spark, sf_dir).select(F.col("n").alias("event_id"), S.age_seconds(F.col("ts"), at).alias("age"))


@query("e11_truncate_text", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 997) || '...' ELSE text END AS text FROM documents")
def e11(spark, sf_dir):
    return feed.table(spark, sf_dir, "documents").select("doc_id", S.truncate_text(F.col("text"), 1000).alias("text"))


_STATUSES = (200, 204, 301, 304, 307, 403, 404, 410, 422, 429, 500, 503, 100)


@query("e12_http_class", f"""
SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status = 304 THEN 'not_modified'
  WHEN status IN (301, 307) THEN CASE WHEN event_id % 2 = 0 THEN 'redirect' ELSE 'client_error' END
  WHEN status IN (403, 429) THEN CASE WHEN event_id % 3 = 0 THEN 'rate_limited' ELSE 'secondary_limited' END
  WHEN status IN (404, 410) THEN 'not_found' WHEN status >= 500 THEN 'server_error' ELSE 'client_error' END AS http_class
FROM (SELECT event_id, [{', '.join(map(str, _STATUSES))}][CAST(event_id % {len(_STATUSES)} AS INTEGER) + 1] AS status FROM events)""")
def e12(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in _STATUSES]), (F.col("n") % len(_STATUSES) + 1).cast("int"))
    headers = F.create_map(F.lit("Location"), F.when(F.col("n") % 2 == 0, "/x").otherwise(""),
                           F.lit("X-RateLimit-Remaining"), F.when(F.col("n") % 3 == 0, " 0").otherwise("7"))
    rows = feed.events(spark, sf_dir).select(F.col("n").alias("event_id"), status.alias("status"), headers.alias("h"))
    return rows.select("event_id", http_class(F.col("status"), F.col("h")).alias("http_class"))


@query("e13_rate_limit_fields", X.deliveries(f"""
SELECT run_id, page_no, 'core' AS resource, CAST(60 AS BIGINT) AS "limit", 60 - page_no - run % 3 AS remaining, page_no + run % 3 AS used,
  {X.iso("date_trunc('day', max(received_at)) + INTERVAL 1 DAY")} AS reset_at, CAST(60 AS BIGINT) AS poll_interval_seconds,
  CAST(NULL AS BIGINT) AS retry_after_seconds, 'W/"' || run || '"' AS etag FROM d GROUP BY run_id, page_no, run"""))
def e13(spark, sf_dir):
    log = feed.fetch_log(spark, sf_dir)
    read = log.select("run_id", "page_no", rate_limit_fields(F.col("headers"), F.col("received_at")).alias("q"))
    return read.select("run_id", "page_no", "q.*").withColumn("reset_at", S.iso8601(F.col("reset_at")))


@query("e14_url_violations", """
SELECT page_id, array_to_string(list_filter([
  CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme_not_allowed' END,
  CASE WHEN regexp_extract(url, '^https?://([^/?#]+)', 1) <> 'api.github.com' THEN 'host_not_allowed' END], lambda x: x IS NOT NULL), ',') AS violations
FROM pages""")
def e14(spark, sf_dir):
    return feed.table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(url_violations(F.col("url")), ",").alias("violations"))


# --- F -----------------------------------------------------------------------------------


@query("f1_events_with_entities", X.state("""
SELECT github_event_id, actor.identifier AS login, repository.identifier AS full_name, actor.enrichment_status AS actor_status
FROM pushes JOIN actor ON actor.g = actor_id JOIN repository ON repository.g = repo_id""", X.PUSHES))
def f1(spark, sf_dir):
    return listings.events_with_entities(feed.push_events(spark, sf_dir), *_entities(spark, sf_dir)).select(
        "github_event_id", "login", "full_name", "actor_status")


def _page_sql(where: str, limit: int) -> str:
    return f"""
, page AS (SELECT *, row_number() OVER (ORDER BY occurred_at DESC, seq DESC) AS k, count(*) OVER () AS total FROM pushes WHERE {where} QUALIFY k <= {limit})
SELECT github_event_id, actor.identifier AS login, repository.identifier AS full_name, CASE WHEN total > {limit} THEN
  (SELECT rtrim(replace(replace(to_base64(encode({X.micros('occurred_at')} || '|' || seq)), '+', '-'), '/', '_'), '=') FROM page WHERE k = {limit}) END AS next_cursor
FROM page LEFT JOIN (SELECT * FROM actor WHERE g % 4 <> 0) actor ON actor.g = actor_id LEFT JOIN repository ON repository.g = repo_id"""


def _page(spark, sf_dir, request) -> DataFrame:
    actors, repositories = _entities(spark, sf_dir)
    page = listings.event_page(feed.push_events(spark, sf_dir), request)
    viewed = listings.event_view(listings.with_entities(page, actors.where("github_id % 4 <> 0"), repositories))
    return viewed.select(F.col("id").alias("github_event_id"), "actor.login", "repository.full_name", "next_cursor")


@query("f2_left_lookup", X.state(_page_sql("true", 100), X.PUSHES))
def f2(spark, sf_dir):
    return _page(spark, sf_dir, listings.page_request(limit=100))


@query("f3_anti_join", X.state("""
SELECT github_event_id FROM pushes WHERE actor_id NOT IN (SELECT g FROM actor WHERE g % 4 <> 0)""", X.PUSHES))
def f3(spark, sf_dir):
    known = feed.entities(spark, sf_dir, "actor").where("github_id % 4 <> 0").select(F.col("github_id").alias("github_actor_id"))
    return feed.push_events(spark, sf_dir).join(known, "github_actor_id", "left_anti").select("github_event_id")


@query("f5_union_labelled", X.state("""
SELECT entity_kind, identifier, github_id, enrichment_status FROM actor UNION ALL SELECT entity_kind, identifier, github_id, enrichment_status FROM repository"""))
def f5(spark, sf_dir):
    return listings.labelled_entities(*_entities(spark, sf_dir)).select(
        "entity_kind", "identifier", "github_id", "enrichment_status")


@query("f6_latest_batches", f"""WITH {X.BATCHES}
SELECT request_kind, entity_kind, status, CAST(requested_count AS INTEGER) AS requested_count, CAST(valid_count AS INTEGER) AS valid_count,
  {X.micros('started_at')} AS started_at FROM batches ORDER BY started_at DESC, correlation_id DESC LIMIT 10""")
def f6_batches(spark, sf_dir):
    return listings.latest_batches(feed.batches(spark, sf_dir)).select(
        "request_kind", "entity_kind", "status", "requested_count", "valid_count", _us(F.col("started_at")).alias("started_at"))


@query("f6_latest_runs", f"""WITH {X.RUNS}
SELECT run_id, status, {X.micros('started_at')} AS started_at, made AS events_created, pushed - made AS duplicates_skipped
FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 5""")
def f6_runs(spark, sf_dir):
    return listings.latest_runs(feed.ingestion_runs(spark, sf_dir)).select(
        "run_id", "status", _us(F.col("started_at")).alias("started_at"), "events_created", "duplicates_skipped")


@query("f6_latest_observations", X.deliveries(f"""
, seen AS (SELECT 'actor' AS entity_kind, actor_id AS entity_github_id, received_at, sha256('event|' || id || '|actor') AS oid FROM created
  UNION ALL SELECT 'repository', repo_id, received_at, sha256('event|' || id || '|repository') FROM created)
SELECT entity_kind, entity_github_id, {X.micros('received_at')} AS observed_at FROM seen ORDER BY received_at DESC, oid DESC LIMIT 10""", X.CREATED))
def f6_observations(spark, sf_dir):
    from feedledger.operators.evidence import event_observations

    rows = event_observations(dedup_new(landed(
        spark, sf_dir, (*RESULT_COLUMNS, "push", "actor_fragment", "repo_fragment"))))
    return listings.latest_observations(rows).select(
        "entity_kind", "entity_github_id", _us(F.col("observed_at")).alias("observed_at"))


@query("f6_most_quarantined", X.deliveries(f"""
SELECT any_value(id) AS github_event_id, any_value(type) AS event_type, any_value(code) AS error_code, count(*) AS occurrence_count
FROM d WHERE outcome = 'quarantined' GROUP BY sha256({X.CANONICAL}) ORDER BY count(*) DESC, sha256({X.CANONICAL}) LIMIT 20""")
       .replace(f"ORDER BY count(*) DESC, sha256({X.CANONICAL})", "ORDER BY count(*) DESC, any_value(fp)")
       .replace("GROUP BY sha256(" + X.CANONICAL + ")", "GROUP BY fp")
       .replace("FROM d WHERE outcome = 'quarantined'", f"FROM (SELECT *, sha256({X.CANONICAL}) AS fp FROM d) WHERE outcome = 'quarantined'"))
def f6_quarantine(spark, sf_dir):
    from feedledger.operators.dedup import quarantine_merge

    return listings.most_quarantined(quarantine_merge(landed(spark, sf_dir, MERGE_COLUMNS)), 20).select(
        "github_event_id", "event_type", "error_code", "occurrence_count")


@query("f7_event_page", X.state(_page_sql("true", 25), X.PUSHES))
def f7(spark, sf_dir):
    return _page(spark, sf_dir, listings.page_request())


@query("f7_event_page_seek", X.state(_page_sql(
    "repo_id = 1007 AND occurred_at <= TIMESTAMP '2024-01-15 03:00:00' AND (occurred_at < TIMESTAMP '2024-01-15 03:00:00' OR seq < 4000)", 5), X.PUSHES))
def f7_seek(spark, sf_dir):
    cursor = spark.range(1).select(encode_cursor(
        F.lit("2024-01-15 03:00:00").cast("timestamp"), F.lit(4000)).alias("c")).first()["c"]
    return _page(spark, sf_dir, listings.page_request(limit="5", cursor=cursor, repository_id="1007"))


@query("f9_event_by_id", X.state("""
SELECT github_event_id, actor.identifier AS login, '{"n":' || n || ',"event_type":"' || event_type || '"}' AS raw_payload
FROM pushes JOIN actor ON actor.g = actor_id WHERE github_event_id = (SELECT max(github_event_id) FROM pushes)""", X.PUSHES))
def f9(spark, sf_dir):
    events = feed.push_events(spark, sf_dir)
    newest = events.agg(F.max("github_event_id").alias("id")).first()["id"]
    found = listings.event_by_id(events, *_entities(spark, sf_dir), newest)
    return found.select(F.col("id").alias("github_event_id"), "actor.login", "raw_payload")


@query("f10_event_view", X.state(f"""
SELECT github_event_id AS id, '{{"github_id":' || actor_id || ',"login":"' || actor.identifier || '","enrichment_status":"' || actor.enrichment_status || '"'
  || CASE WHEN actor.fetched_at IS NULL THEN '' ELSE ',"fetched_at":"' || {X.iso('actor.fetched_at')} || '"' END || '}}' AS actor,
  {X.iso('occurred_at')} AS occurred_at, {X.iso('pushes.created_at')} AS ingested_at
FROM (SELECT * FROM pushes ORDER BY occurred_at DESC, seq DESC LIMIT 25) pushes JOIN actor ON actor.g = actor_id""", X.PUSHES))
def f10(spark, sf_dir):
    page = listings.event_page(feed.push_events(spark, sf_dir))
    viewed = listings.event_view(listings.with_entities(page, *_entities(spark, sf_dir)))
    return viewed.select("id", F.to_json("actor").alias("actor"), "occurred_at", "ingested_at")


# --- G -----------------------------------------------------------------------------------


_TALLY = """
SELECT d.run_id, CAST(11 AS BIGINT) AS pages_fetched, count(*) AS events_received, count(*) FILTER (WHERE type = 'PushEvent') AS push_events_seen,
  count(*) FILTER (WHERE c.id IS NOT NULL) AS events_created, count(*) FILTER (WHERE outcome = 'push_event' AND c.id IS NULL) AS duplicates_skipped,
  count(*) FILTER (WHERE outcome = 'quarantined') AS events_quarantined, count(*) FILTER (WHERE outcome = 'ignored') AS events_ignored,
  CAST(0 AS BIGINT) AS events_failed
FROM d LEFT JOIN (SELECT id, run_id, page_no, pos FROM created) c ON d.id = c.id AND d.run_id = c.run_id AND d.page_no = c.page_no AND d.pos = c.pos
GROUP BY d.run_id"""


def _tally(spark, sf_dir) -> DataFrame:
    rows = landed(spark, sf_dir, RESULT_COLUMNS)
    return run_tally(delivery_results(rows, dedup_new(rows)), feed.fetch_log(spark, sf_dir))


@query("g1_run_tally", X.deliveries(_TALLY, X.CREATED))
def g1(spark, sf_dir):
    return _tally(spark, sf_dir)


@query("g1_tally_identities", X.deliveries(f"SELECT * FROM ({_TALLY}) WHERE false", X.CREATED))
def g1_identities(spark, sf_dir):
    return tally_identities(_tally(spark, sf_dir))


@query("g1_tally_identities_broken", X.deliveries(f"""
SELECT run_id, events_received, events_created + 1 AS events_created, push_events_seen FROM ({_TALLY}) WHERE run_id LIKE '%3'
UNION ALL SELECT run_id, events_received, events_created, events_received - events_ignored + 1 FROM ({_TALLY}) WHERE run_id LIKE '%7'""", X.CREATED))
def g1_broken(spark, sf_dir):
    """Tallies of some runs are made to contradict themselves; just these are found."""
    tally = stage(_tally(spark, sf_dir), "tally")
    wrong = tally.withColumns({
        "events_created": F.col("events_created") + F.when(F.col("run_id").endswith("3"), 1).otherwise(0),
        "push_events_seen": F.when(F.col("run_id").endswith("7"), F.col("events_received") - F.col("events_ignored") + 1)
        .otherwise(F.col("push_events_seen"))})
    return tally_identities(wrong).select("run_id", "events_received", "events_created", "push_events_seen")


_COVERAGE_SECONDS = 864_000


@query("g2_coverage", X.state(f"""
, joined AS (SELECT pushes.*, actor.enrichment_status = 'complete' AS a, repository.enrichment_status = 'complete' AS r FROM pushes
  JOIN actor ON actor.g = actor_id JOIN repository ON repository.g = repo_id WHERE pushes.created_at > {X.NOW_SQL} - INTERVAL {_COVERAGE_SECONDS} SECOND),
counts AS (SELECT count(*) AS event_count, count(DISTINCT actor_id) AS actor_count, count(DISTINCT actor_id) FILTER (WHERE a) AS complete_actor_count,
  count(DISTINCT repo_id) AS repository_count, count(DISTINCT repo_id) FILTER (WHERE r) AS complete_repository_count,
  count(*) FILTER (WHERE a AND r) AS both_complete_event_count FROM joined)
SELECT *, round(100.0::DOUBLE * complete_actor_count / nullif(actor_count, 0), 2) AS actor_coverage_pct,
  round(100.0::DOUBLE * complete_repository_count / nullif(repository_count, 0), 2) AS repository_coverage_pct,
  round(100.0::DOUBLE * both_complete_event_count / nullif(event_count, 0), 2) AS events_with_both_entities_enriched_pct FROM counts""", X.PUSHES))
def g2(spark, sf_dir):
    return reports.coverage(feed.push_events(spark, sf_dir), *_entities(spark, sf_dir), feed.now(),
                            _COVERAGE_SECONDS).drop("window_seconds", "window_start")


_WINDOW = 14_400


def _metrics_sql(kind: str) -> str:
    floor = f"{X.NOW_SQL} - INTERVAL {_WINDOW} SECOND"
    statuses = ", ".join(f"count(*) FILTER (WHERE enrichment_status = '{s}') AS status_{s}" for s in (
        "pending", "complete", "retryable_failure", "permanent_failure"))
    stages = ", ".join(
        f"count(*) FILTER (WHERE enrichment_stage = '{s}') AS stage_{s}, {X.micros('min(created_at) FILTER (WHERE enrichment_stage = ' + repr(s) + ')')} AS oldest_{s}"
        for s in ("batch_pending", "batch_in_flight", "detail_pending", "detail_in_flight", "retry_scheduled", "contract_complete", "terminal"))
    pending = "min(created_at) FILTER (WHERE enrichment_status IN ('pending', 'retryable_failure'))"
    return f"""SELECT '{kind}' AS entity_kind, {statuses}, {stages},
  count(*) FILTER (WHERE enrichment_status IN ('pending', 'retryable_failure')) AS backlog_count, {X.micros(pending)} AS oldest_pending_at,
  count(*) FILTER (WHERE enrichment_stage NOT IN ('contract_complete', 'terminal') AND enrichment_status <> 'complete') AS contract_backlog_count,
  count(*) FILTER (WHERE created_at > {floor}) AS arrivals, count(*) FILTER (WHERE contract_completed_at > {floor}) AS completions,
  count(*) FILTER (WHERE terminal_at > {floor}) AS terminals, {X.micros('min(created_at)')} AS earliest_created_at,
  CAST(floor((epoch_us({X.NOW_SQL}) - epoch_us({pending})) / 1000000.0) AS BIGINT) AS oldest_pending_age_seconds FROM {kind}"""


def _metrics(spark, sf_dir):
    return [reports.backlog_metrics(kind, feed.entities(spark, sf_dir, kind), feed.now(), _WINDOW)
            for kind in ("actor", "repository")]


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[(_us(F.col(f.name)) if f.dataType.typeName() == "timestamp" else F.col(f.name)).alias(f.name)
                       for f in df.schema.fields])


@query("g3_backlog_metrics", X.state(f"{_metrics_sql('actor')} UNION ALL {_metrics_sql('repository')}"))
def g3(spark, sf_dir):
    actor, repository = _metrics(spark, sf_dir)
    return _texts(actor.unionByName(repository))


@query("g4_contract_backlog", X.state("""
SELECT github_id FROM actor WHERE enrichment_stage NOT IN ('contract_complete', 'terminal') AND enrichment_status <> 'complete'"""))
def g4(spark, sf_dir):
    return reports.contract_backlog(feed.entities(spark, sf_dir, "actor")).select("github_id")


@query("g5_batch_quality", f"""WITH {X.BATCHES},
kinds AS (SELECT * FROM (VALUES ('search', 'actor'), ('search', 'repository'), ('detail', 'actor'), ('detail', 'repository')) t(request_kind, entity_kind)),
recent AS (SELECT * FROM batches WHERE started_at >= {X.NOW_SQL} - INTERVAL 864000 SECOND)
SELECT k.request_kind, k.entity_kind, count(r.b) AS attempts, {', '.join(f"count(*) FILTER (WHERE r.status = '{s}') AS {s}" for s in ('in_flight', 'succeeded', 'failed', 'deferred', 'stale_lease'))},
  {', '.join(f"CAST(coalesce(sum(r.{c}_count), 0) AS BIGINT) AS {c}_items" for c in ('requested', 'returned', 'valid', 'missing', 'invalid'))},
  count(*) FILTER (WHERE r.incomplete_results) AS incomplete_results_count,
  round(CAST(sum(r.returned_count) AS DOUBLE) / nullif(sum(r.requested_count), 0), 3) AS fill_ratio
FROM kinds k LEFT JOIN recent r USING (request_kind, entity_kind) GROUP BY 1, 2""")
def g5(spark, sf_dir):
    return reports.batch_quality(feed.batches(spark, sf_dir), feed.now(), 864_000)


def _lane(name: str, alias: str) -> str:
    return f"""{alias}.arrivals AS {name}_arrivals, {alias}.completions AS {name}_completions, {alias}.terminals AS {name}_terminals,
  {alias}.completions + {alias}.terminals AS {name}_exits, round({alias}.arrivals * 3600.0::DOUBLE / s.secs, 2) AS {name}_arrival_rate_per_hour,
  round({alias}.completions * 3600.0::DOUBLE / s.secs, 2) AS {name}_completion_rate_per_hour,
  {alias}.arrivals - {alias}.completions - {alias}.terminals AS {name}_backlog_delta"""


_THROUGHPUT = X.state(f"""
, ma AS ({_metrics_sql('actor')}), mr AS ({_metrics_sql('repository')}),
mc AS (SELECT ma.arrivals + mr.arrivals AS arrivals, ma.completions + mr.completions AS completions, ma.terminals + mr.terminals AS terminals,
  ma.contract_backlog_count + mr.contract_backlog_count AS backlog FROM ma, mr),
s AS (SELECT {_WINDOW} AS secs)
SELECT {_lane('actor', 'ma')}, {_lane('repository', 'mr')}, {_lane('combined', 'mc')}, CAST(s.secs AS BIGINT) AS sample_seconds,
  CASE WHEN mc.arrivals - mc.completions - mc.terminals < 0 THEN 'keeping_up'
       WHEN mc.arrivals - mc.completions - mc.terminals = 0 AND mc.backlog = 0 THEN 'keeping_up' ELSE 'not_keeping_up' END AS catch_up_state
FROM ma, mr, mc, s""")


@query("g6_throughput", _THROUGHPUT)
def g6(spark, sf_dir):
    return reports.throughput(*_metrics(spark, sf_dir), feed.now(), _WINDOW).drop(
        "window_seconds", "window_start", "sample_started_at")


@query("g7_catch_up_state", """
SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 1800 < 900 THEN 'insufficient_sample' WHEN event_id % 5 - 2 < 0 THEN 'keeping_up'
  WHEN event_id % 5 = 2 AND event_id % 3 = 0 THEN 'keeping_up' ELSE 'not_keeping_up' END AS state FROM events""")
def g7(spark, sf_dir):
    n = F.col("n")
    return feed.events(spark, sf_dir).select(n.alias("event_id"), reports.catch_up_state(
        n % 5 - 2, n % 3, F.when(n % 4 != 0, n % 1800)).alias("state"))


@query("g8_latest_run_per_source", f"""WITH {X.RUNS}
SELECT source_id, run_id, status, {X.micros('completed_at')} AS completed_at FROM runs WHERE completed_at IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY completed_at DESC, run_id DESC) = 1""")
def g8(spark, sf_dir):
    return _texts(reports.latest_run_per_source(feed.ingestion_runs(spark, sf_dir)))


@query("g9_latest_successful_run", f"""WITH {X.RUNS}
SELECT run_id, status, {X.micros('completed_at')} AS completed_at FROM runs WHERE status IN ('completed', 'not_modified') AND completed_at IS NOT NULL
ORDER BY completed_at DESC, run_id DESC LIMIT 1""".replace("ORDER BY completed_at", "ORDER BY runs.completed_at"))
def g9(spark, sf_dir):
    return _texts(reports.latest_successful_run(feed.ingestion_runs(spark, sf_dir)).select("run_id", "status", "completed_at"))


_SCHEDULE = f"""
plan AS (SELECT sources.*, budget.*, CASE WHEN poll_used >= poll_allowance THEN budget.reset_at END AS blocked FROM sources, budget),
best AS (SELECT *, greatest(cadence_due_at, poll_floor_until, retry_not_before_at, blocked) AS next_at FROM plan)"""


@query("g10_state_summary", X.state(f"""
SELECT {X.micros('(SELECT max(completed_at) FROM good)')} AS latest_run_at, (SELECT arg_max(run_id, (completed_at, run_id)) FROM good) AS latest_run_id,
  (SELECT count(*) FROM pushes) AS push_event_count,
  (SELECT count(*) FROM actor WHERE enrichment_status IN ('pending', 'retryable_failure')) AS pending_actor_count,
  (SELECT count(*) FROM repository WHERE enrichment_status IN ('pending', 'retryable_failure')) AS pending_repository_count,
  'core' AS budget_resource, CAST((SELECT remaining FROM budget) AS BIGINT) AS budget_remaining, {X.micros('(SELECT reset_at FROM budget)')} AS budget_reset_at,
  'active' AS window_status, CAST(NULL AS VARCHAR) AS global_blocked_until, true AS source_present,
  {X.micros('(SELECT arg_min(next_at, id) FROM best)')} AS next_poll_at""", X.PUSHES, X.RUNS, X.SOURCES, X.BUDGET, _SCHEDULE,
    "\ngood AS (SELECT * FROM runs WHERE status IN ('completed', 'not_modified'))"))
def g10(spark, sf_dir):
    budget = feed.core_budget(spark, sf_dir)
    plan = schedule.source_schedule(feed.event_sources(spark, sf_dir), budget, feed.now())
    return _texts(reports.state_summary(
        feed.ingestion_runs(spark, sf_dir), feed.push_events(spark, sf_dir), *_entities(spark, sf_dir), budget, plan))


@query("g11_source_schedule", f"""WITH {X.RUNS},{X.SOURCES},{X.BUDGET},{_SCHEDULE}
SELECT id, {X.micros('next_at')} AS next_poll_at, CASE WHEN cadence_due_at = next_at THEN 'cadence_due_at' WHEN poll_floor_until = next_at THEN 'poll_floor_until'
  WHEN retry_not_before_at = next_at THEN 'retry_not_before_at' ELSE 'poll_class_blocked_until' END AS binding_component,
  coalesce(next_at <= {X.NOW_SQL}, true) AS due_now FROM best""")
def g11(spark, sf_dir):
    plan = schedule.source_schedule(feed.event_sources(spark, sf_dir), feed.core_budget(spark, sf_dir), feed.now())
    return _texts(plan.select("id", "next_poll_at", "binding_component", "due_now"))


@query("g13_poll_due", f"""WITH {X.RUNS},{X.SOURCES}
SELECT id FROM sources WHERE source_type = 'public_events' AND enabled AND status = 'idle' AND (next_poll_at IS NULL OR next_poll_at <= {X.NOW_SQL})""")
def g13(spark, sf_dir):
    return schedule.poll_due(feed.event_sources(spark, sf_dir), "public_events", feed.now()).select("id")


def _run_log(spark, sf_dir) -> DataFrame:
    grouped = feed.events(spark, sf_dir).groupBy(F.floor(F.col("n") / 100).cast("long").alias("b")).agg(F.min("ts").alias("t"))
    klass = F.element_at(F.array(*[F.lit(k) for k in (
        "ok", "server_error", "secondary_limited", "server_error", "not_modified", "rate_limited", "server_error")]),
        (F.col("b") % 7 + 1).cast("int"))
    return grouped.select(
        (F.col("b") % 5).alias("source_id"), F.format_string("run-%08d", "b").alias("run_id"), F.col("t").alias("polled_at"),
        F.when((F.col("b") % 5 == 4) & (F.col("b") % 7 == 3), "not_found").otherwise(klass).alias("http_class"),
        F.lit(60).cast("long").alias("poll_interval_seconds"), F.concat(F.lit("e"), F.col("b").cast("string")).alias("etag"),
        F.when(F.col("b") % 7 == 2, 120).cast("long").alias("retry_after_seconds"), F.lit(None).cast("string").alias("error_message"))


@query("g14_source_health", f"""
WITH log AS (SELECT b % 5 AS source_id, 'run-' || lpad(CAST(b AS VARCHAR), 8, '0') AS run_id, t, b,
    CASE WHEN b % 5 = 4 AND b % 7 = 3 THEN 'refused' WHEN b % 7 IN (0, 4) THEN 'success' WHEN b % 7 IN (1, 3, 6) THEN 'failure'
         WHEN b % 7 = 2 THEN 'secondary' ELSE 'deferred' END AS kind
  FROM (SELECT event_id // 100 AS b, min(ts) AS t FROM events GROUP BY 1)),
last AS (SELECT source_id, max(b) FILTER (WHERE kind = 'success') AS s FROM log GROUP BY 1),
health AS (SELECT log.source_id, bool_or(kind = 'refused') AS refused, max(t) AS last_polled_at, max(t) FILTER (WHERE kind = 'success') AS last_success_at,
    count(*) FILTER (WHERE kind = 'failure' AND b > coalesce(s, -1)) AS failures,
    arg_max(kind, b) FILTER (WHERE kind IN ('success', 'failure', 'secondary')) AS rk, max(t) FILTER (WHERE kind IN ('success', 'failure', 'secondary')) AS rt
  FROM log JOIN last USING (source_id) GROUP BY 1)
SELECT source_id, CASE WHEN refused THEN 'failed' ELSE 'idle' END AS status, CAST(failures AS INTEGER) AS consecutive_failures,
  {X.micros('last_polled_at')} AS last_polled_at, {X.micros('last_success_at')} AS last_success_at,
  {X.micros('''CASE rk WHEN 'failure' THEN rt + to_seconds(least(60 * CAST(pow(2, failures - 1) AS INTEGER), 3600)) WHEN 'secondary' THEN rt + INTERVAL 120 SECOND END''')} AS retry_not_before_at
FROM health""")
def g14(spark, sf_dir):
    return _texts(schedule.source_health(_run_log(spark, sf_dir)).select(
        "source_id", "status", "consecutive_failures", "last_polled_at", "last_success_at", "retry_not_before_at"))


@query("g15_quota_by_window", X.deliveries(f"""
, seen AS (SELECT 'core' AS resource, date_trunc('day', max(received_at)) + INTERVAL 1 DAY AS reset_at, 60 AS q_limit, 60 - page_no - run % 3 AS rem, page_no + run % 3 AS used, 'poll' AS origin
    FROM d GROUP BY run, page_no
  UNION ALL SELECT resource, q_reset, q_limit, q_remaining, q_used, 'lookup' FROM batches WHERE resource IS NOT NULL)
SELECT resource, {X.micros('reset_at')} AS reset_at, CAST(max(q_limit) AS BIGINT) AS "limit", CAST(min(rem) AS BIGINT) AS least_remaining, CAST(max(used) AS BIGINT) AS greatest_used,
  count(*) FILTER (WHERE origin = 'poll') AS polls, count(*) FILTER (WHERE origin = 'lookup') AS lookups, greatest(CAST(max(used) AS BIGINT) - count(*), 0) AS used_by_others
FROM seen GROUP BY resource, seen.reset_at""", X.BATCHES))
def g15(spark, sf_dir):
    return _texts(reports.quota_by_window(feed.fetch_log(spark, sf_dir), feed.batches(spark, sf_dir)))


@query("g19_next_due", X.state(f"""
, e AS (SELECT entity_kind, enrichment_status, enrichment_stage, next_retry_at, leased_until, fetched_at, last_seen_at FROM actor
  UNION ALL SELECT entity_kind, enrichment_status, enrichment_stage, next_retry_at, leased_until, fetched_at, last_seen_at FROM repository),
m AS (SELECT min(next_retry_at) FILTER (WHERE enrichment_stage <> 'terminal' AND next_retry_at >= {X.NOW_SQL}) AS r,
  min(leased_until) FILTER (WHERE leased_until >= {X.NOW_SQL}) AS l,
  greatest(min(fetched_at) FILTER (WHERE enrichment_status = 'complete' AND enrichment_stage = 'contract_complete'
    AND last_seen_at >= {X.NOW_SQL} - INTERVAL 7 DAY) + INTERVAL 1 DAY, {X.NOW_SQL}) AS f FROM e)
SELECT {X.micros('r')} AS next_retry_at, {X.micros('l')} AS next_lease_expiry_at, {X.micros('f')} AS next_refresh_at, {X.micros('least(r, l, f)')} AS next_due_at FROM m"""))
def g19(spark, sf_dir):
    return _texts(reports.next_due(*_entities(spark, sf_dir), feed.now()))


@query("g20_table_counts", X.state("""
SELECT 'push_events' AS measure, count(*) AS n FROM pushes UNION ALL SELECT 'actors', count(*) FROM actor UNION ALL SELECT 'repositories', count(*) FROM repository
UNION ALL SELECT 'runs', count(*) FROM runs UNION ALL SELECT 'quarantined', count(DISTINCT n) FROM d WHERE outcome = 'quarantined'
UNION ALL SELECT 'occurrences', count(*) FROM d WHERE outcome = 'quarantined'""", X.PUSHES, X.RUNS, X.DELIVERIES))
def g20(spark, sf_dir):
    from feedledger.operators.dedup import quarantine_merge

    return reports.table_counts(feed.push_events(spark, sf_dir), *_entities(spark, sf_dir),
                                quarantine_merge(landed(spark, sf_dir, MERGE_COLUMNS)), feed.ingestion_runs(spark, sf_dir))


@query("g20_status_counts", X.state("""
SELECT entity_kind, enrichment_status, count(*) AS n FROM actor GROUP BY 1, 2 UNION ALL SELECT entity_kind, enrichment_status, count(*) FROM repository GROUP BY 1, 2"""))
def g20_status(spark, sf_dir):
    return reports.status_counts(*_entities(spark, sf_dir))


_STATE_SQL = X.state("""
, rows AS (
  SELECT sha256(concat_ws('|', entity_kind, g, epoch_us(first_seen_at), epoch_us(last_seen_at), epoch_us(latest_event_at))) AS h
  FROM (SELECT entity_kind, g, first_seen_at, last_seen_at, latest_event_at FROM actor
        UNION ALL SELECT entity_kind, g, first_seen_at, last_seen_at, latest_event_at FROM repository)),
words AS (SELECT count(*) AS entities, """ + ", ".join(
    f"(sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT AS w{k}" for k in range(4)) + """ FROM rows)
SELECT entities, sha256(concat_ws('|', entities, w0, w1, w2, w3)) AS digest FROM words""")


@query("g21_entity_state_fingerprint", _STATE_SQL)
def g21(spark, sf_dir):
    return reports.entity_state_fingerprint(*_entities(spark, sf_dir))


@query("g21_after_batch", _STATE_SQL)
def g21_after_batch(spark, sf_dir):
    """The digest kept up from changed rows alone: first without repositories and with stale actors, then mended."""
    actors, repositories = _entities(spark, sf_dir)
    touched = F.col("github_id") % 5 == 0
    stale = actors.where(touched).withColumn("last_seen_at", F.col("first_seen_at") - F.expr("INTERVAL 1 DAY"))
    state = reports.entity_state_sums(actors.where(~touched).unionByName(stale), "actor")
    state = reports.changed_state(state, reports.entity_state_sums(stale, "actor"), reports.entity_state_sums(actors.where(touched), "actor"))
    nothing = reports.entity_state_sums(repositories.limit(0), "repository")
    return reports.state_digest(reports.changed_state(state, nothing, reports.entity_state_sums(repositories, "repository")))


@query("g22_status_report")
def g22(spark, sf_dir):
    actors, repositories = _entities(spark, sf_dir)
    report = status_report(
        feed.push_events(spark, sf_dir), actors, repositories, feed.batches(spark, sf_dir),
        feed.ingestion_runs(spark, sf_dir), feed.event_sources(spark, sf_dir), feed.core_budget(spark, sf_dir),
        feed.search_budget(spark, sf_dir), feed.now())
    return report.select("captured_at", *[
        F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in report.columns if c != "captured_at"])


# --- H -----------------------------------------------------------------------------------


def _land(log: DataFrame, landing: str) -> None:
    writer = log.drop("run").write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    with freed_shuffles(log.sparkSession):
        writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(landing)


def _landed(spark, sf_dir) -> str:
    landing = _folder(spark, "landing")
    _land(feed.fetch_log(spark, sf_dir), landing)
    return landing


def _streamed(spark, landing: str) -> str:
    root = _folder(spark, "tables")
    ingest_stream(spark, landing, root, _folder(spark, "mark"), max_pages=11).awaitTermination()
    return root


_RUN_COLUMNS = ("run_id", "pages_fetched", "events_received", "push_events_seen", "events_created",
                "duplicates_skipped", "events_quarantined", "events_failed")


@query("h1_ingest_stream", X.deliveries(f"SELECT {', '.join(_RUN_COLUMNS)} FROM ({_TALLY})", X.CREATED))
def h1(spark, sf_dir):
    return read_log(spark, _streamed(spark, _landed(spark, sf_dir)), "ingestion_runs").select(*_RUN_COLUMNS)


@query("h1_new_checkpoint", X.deliveries(f"""
SELECT {', '.join(_RUN_COLUMNS)} FROM ({_TALLY})
UNION ALL SELECT 'again-' || run_id, pages_fetched, events_received, push_events_seen, 0, events_created + duplicates_skipped, events_quarantined, events_failed
FROM ({_TALLY})""", X.CREATED))
def h1_new_checkpoint(spark, sf_dir):
    """A second stream with a checkpoint of its own goes on from the first one's tables."""
    first, landing = _landed(spark, sf_dir), _folder(spark, "landing")
    root = _streamed(spark, first)
    log = read_fetch_log(spark, first)
    _land(log.withColumn("run_id", F.concat(F.lit("again-"), "run_id"))
          .withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 40 DAYS")), landing)
    discard(spark, first)  # the first stream has ended
    ingest_stream(spark, landing, root, _folder(spark, "mark"), max_pages=11).awaitTermination()
    return read_log(spark, root, "ingestion_runs").select(*_RUN_COLUMNS)


@query("h5_split_run", X.deliveries(f"SELECT {', '.join(_RUN_COLUMNS)} FROM ({_TALLY})", X.CREATED))
def h5_split_run(spark, sf_dir):
    """Every run lands in three pieces, the stream starting anew after each."""
    root, landing, mark = (_folder(spark, n) for n in ("tables", "landing", "mark"))
    log = stage(feed.fetch_log(spark, sf_dir), "pages")
    for first, last in ((1, 3), (4, 10), (11, 11)):
        _land(log.where(F.col("page_no").between(first, last)), landing)
        ingest_stream(spark, landing, root, mark, max_pages=11).awaitTermination()
    return read_log(spark, root, "ingestion_runs").select(*_RUN_COLUMNS)


@query("h2_unbounded_dedup", X.deliveries("SELECT id AS github_event_id, count(*) AS n FROM created GROUP BY 1", X.CREATED))
def h2(spark, sf_dir):
    return read_log(spark, _streamed(spark, _landed(spark, sf_dir)), "push_events").groupBy("github_event_id").agg(F.count("*").alias("n"))


@query("h3_late_data", X.deliveries(f"""
SELECT actor_id AS github_id, {X.micros('max(occurred_at)')} AS latest_event_at, {X.micros('max(received_at)')} AS last_seen_at FROM created GROUP BY 1""", X.CREATED))
def h3(spark, sf_dir):
    rows = landed(spark, sf_dir, (*RESULT_COLUMNS, "actor", "push"))
    from feedledger.operators.folds import activity_fold
    from feedledger.schemas import ACTORS

    created = stage(dedup_new(rows), "created")
    newer = activity_fold("actor", created.where("page_no > 5"))
    shape = spark.createDataFrame([], ACTORS)
    old = newer.select(*[(F.col(f.name) if f.name in newer.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                         for f in shape.schema.fields])
    folded = activity_fold("actor", created.where("page_no <= 5"), old)
    return folded.select("github_id", _us(F.col("latest_event_at")).alias("latest_event_at"),
                         _us(F.col("last_seen_at")).alias("last_seen_at"))


@query("h4_stateful_fold", X.deliveries(f"""
SELECT actor_id AS github_id, any_value(login) AS login, any_value(display_login) AS display_login, {X.micros('max(received_at)')} AS updated_at
FROM d WHERE outcome = 'push_event' GROUP BY 1"""))
def h4(spark, sf_dir):
    out = _folder(spark, "folded")
    fold_stream(spark, _landed(spark, sf_dir), "actor", out, _folder(spark, "mark")).awaitTermination()
    newest = F.max_by(F.struct("login", "display_login", "updated_at"), F.struct("updated_at", "version"))
    rows = spark.read.parquet(out).groupBy("github_id").agg(newest.alias("s"))
    return rows.select("github_id", "s.login", "s.display_login", _us(F.col("s.updated_at")).alias("updated_at"))


@query("h5_run_rows", X.deliveries(f"""
SELECT run_id, any_value(run % 5) AS source_id, 'completed' AS status, {X.micros('min(received_at)')} AS started_at, {X.micros('max(received_at)')} AS completed_at
FROM d GROUP BY run_id"""))
def h5(spark, sf_dir):
    root = _folder(spark, "tables")
    with freed_shuffles(spark):
        log = stage(feed.fetch_log(spark, sf_dir).drop("run"), "pages", DENSE)
    ingest_batch(log, root, 0, max_pages=11)
    return _texts(read_log(spark, root, "ingestion_runs").select("run_id", "source_id", "status", "started_at", "completed_at"))


@query("h6_replay_proof", "SELECT true AS same_entities, true AS same_events, true AS counts_doubled")
def h6(spark, sf_dir):
    """The same pages twice, the second time as a new run an hour later."""
    root = _folder(spark, "tables")
    log = stage(feed.fetch_log(spark, sf_dir).drop("run"), "pages")
    ingest_batch(log, root, 0, max_pages=11)

    def facts(suffix: str) -> DataFrame:
        state = reports.entity_state_fingerprint(*[read_snapshot(spark, root, t) for t in ("actors", "repositories")])
        events = read_log(spark, root, "push_events").agg(F.count("*").alias("events"))
        seen = read_snapshot(spark, root, "quarantined_events").agg(
            F.count("*").alias("rows"), F.sum("occurrence_count").alias("occurrences"))
        joined = state.crossJoin(F.broadcast(events)).crossJoin(F.broadcast(seen))
        return stage(joined.select(*[F.col(c).alias(f"{c}_{suffix}") for c in joined.columns]), "facts")

    before = facts("before")
    again = log.withColumn("run_id", F.concat(F.lit("again-"), "run_id")).withColumn(
        "received_at", F.col("received_at") + F.expr("INTERVAL 40 DAYS"))
    ingest_batch(again, root, 1, max_pages=11)
    both = before.crossJoin(F.broadcast(facts("after")))
    return both.select(
        (F.col("digest_before") == F.col("digest_after")).alias("same_entities"),
        (F.col("events_before") == F.col("events_after")).alias("same_events"),
        ((F.col("rows_before") == F.col("rows_after"))
         & (F.col("occurrences_before") * 2 == F.col("occurrences_after"))).alias("counts_doubled"))


@query("h7_continuous_backlog", X.deliveries("""
SELECT 'actor' AS entity_kind, count(DISTINCT actor_id) AS backlog_count FROM d WHERE outcome = 'push_event'
UNION ALL SELECT 'repository', count(DISTINCT repo_id) FROM d WHERE outcome = 'push_event'"""))
def h7(spark, sf_dir):
    root, out = _folder(spark, "tables"), _folder(spark, "reports")
    ingest_and_report_stream(spark, _landed(spark, sf_dir), root, _folder(spark, "mark"), out,
                             max_pages=11).awaitTermination()
    written = spark.read.schema("entity_kind string, backlog_count long, batch long").json(f"{out}/backlog")
    return written.groupBy("entity_kind").agg(F.max_by("backlog_count", "batch").alias("backlog_count"))


@query("a3_page_state", X.deliveries("""
SELECT run_id, page_no, NOT (run % 5 = 1 AND page_no = 4) AS is_array, run % 5 = 2 AND page_no = 6 AS is_empty FROM d GROUP BY run_id, page_no, run"""))
def a3_state(spark, sf_dir):
    return page_state(feed.walk_log(spark, sf_dir)).select("run_id", "page_no", "is_array", "is_empty")
