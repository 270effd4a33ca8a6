"""Queries of sections A, B and C: sources, classification, dedup and folds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedledger.functions.http import header, next_link, request_key
from feedledger.functions.scalars import iso8601, iso8601_micros
from feedledger.operators import classify as B
from feedledger.operators import dedup, evidence, folds, known_ids, upkeep

from feedledger.schemas import ARRIVAL
from feedledger.session import shared_dir, stage
from feedledger.sources import commits, documents, pages, tables
from feedledger.workload import expected as X
from feedledger.workload import feed
from feedledger.workload.registry import query


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.explode_envelopes(feed.fetch_log(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.classify(envelopes(spark, sf_dir))


# What the operators read of classified rows.
RESULT_COLUMNS = (*ARRIVAL, "outcome", "push_typed", "github_event_id", "fragment_undefined")
MERGE_COLUMNS = (*ARRIVAL, "outcome", "github_event_id", "event_type", "error_code", "error_message",
                 "payload_fingerprint", "raw_payload")


def landed(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """Classified rows, or the columns of them that are read, written once, as an ingestion batch does before its joins."""
    return stage(classified(spark, sf_dir).select(*columns), "classified")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.checked_envelopes(envelopes(spark, sf_dir))


# --- A -----------------------------------------------------------------------------------


@query("a1_read_fetch_log", X.deliveries(f"""
SELECT run_id, page_no, {X.iso('max(received_at)')} AS received_at, CAST(200 AS INTEGER) AS status,
  'core' AS resource FROM d GROUP BY run_id, page_no"""))
def a1(spark, sf_dir):
    path = _folder(spark, "landed")
    feed.fetch_log(spark, sf_dir).drop("run").write.json(path)
    log = pages.read_fetch_log(spark, path)
    return log.select("run_id", "page_no", iso8601(F.col("received_at")).alias("received_at"), "status",
                      header(F.col("headers"), "x-ratelimit-resource").alias("resource"))


@query("a2_explode_envelopes", X.deliveries("""
SELECT run_id, page_no, count(*) AS elements, max(pos) AS last_pos FROM d
WHERE NOT (run % 5 = 1 AND page_no = 4) AND NOT (run % 5 = 2 AND page_no = 6) GROUP BY run_id, page_no"""))
def a2(spark, sf_dir):
    return pages.explode_envelopes(feed.walk_log(spark, sf_dir)).groupBy("run_id", "page_no").agg(
        F.count("*").alias("elements"), F.max("pos").alias("last_pos"))


@query("a2_page_errors", """
SELECT 'run-' || lpad(CAST(run AS VARCHAR), 8, '0') AS run_id, CAST(4 AS INTEGER) AS page_no,
  'expected a JSON array of events, got Hash' AS page_error
FROM (SELECT DISTINCT event_id // 1000 AS run FROM events) WHERE run % 5 = 1""")
def a2_errors(spark, sf_dir):
    return pages.page_errors(feed.walk_log(spark, sf_dir))


_STOPS = """
stops AS (SELECT run, CASE run % 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 7 ELSE 8 END AS stop_page,
  CASE run % 5 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 7 ELSE 8 END AS counted_through,
  CASE run % 5 WHEN 1 THEN 'page_error' WHEN 2 THEN 'empty_page' WHEN 3 THEN 'link_loop' WHEN 4 THEN 'no_next_link'
               ELSE 'page_cap' END AS stop_reason
  FROM (SELECT DISTINCT event_id // 1000 AS run FROM events))"""


@query("a3_walk_stops", f"""WITH {_STOPS}
SELECT 'run-' || lpad(CAST(run AS VARCHAR), 8, '0') AS run_id, stop_page, stop_reason, counted_through FROM stops""")
def a3_stops(spark, sf_dir):
    return pages.walk_stops(feed.walk_log(spark, sf_dir), max_pages=8)


@query("a3_walk_order", X.deliveries("""
SELECT DISTINCT run_id, page_no FROM d JOIN stops USING (run) WHERE page_no <= counted_through""", _STOPS))
def a3(spark, sf_dir):
    return pages.walk_order(feed.walk_log(spark, sf_dir), max_pages=8).select("run_id", "page_no")


@query("a4_next_link", X.deliveries("""
SELECT DISTINCT run_id, page_no, CASE WHEN page_no < 11
  THEN 'https://api.example.org/events?per_page=100&page=' || (page_no + 1) END AS next_url FROM d"""))
def a4(spark, sf_dir):
    return feed.fetch_log(spark, sf_dir).select(
        "run_id", "page_no", next_link(header(F.col("headers"), "link")).alias("next_url"))


@query("a5_request_key", """
SELECT page_id, path || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS request_key
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
             regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)""")
def a5(spark, sf_dir):
    return feed.table(spark, sf_dir, "pages").select("page_id", request_key(F.col("url")).alias("request_key"))


@query("a6_read_search_documents", X.lookups("actor", """
SELECT request_batch_id, CASE WHEN verdict IN ('ok', 'deferred') THEN CAST(count(*) FILTER (WHERE returned) + max(extra) AS BIGINT) END AS total_count,
  CASE WHEN verdict IN ('ok', 'deferred') THEN b % 6 = 0 WHEN verdict = 'malformed' THEN false END AS incomplete_results,
  CASE WHEN verdict IN ('ok', 'deferred') THEN CAST(count(*) FILTER (WHERE returned) + max(extra) AS BIGINT)
       WHEN verdict = 'malformed' THEN 0 END AS items,
  CASE verdict WHEN 'rejected' THEN 'Search response items is not an array' WHEN 'failed' THEN 'response body is not valid JSON'
               WHEN 'malformed' THEN 'Search response metadata is malformed' END AS document_error
FROM m GROUP BY request_batch_id, b, verdict"""))
def a6(spark, sf_dir):
    path = _folder(spark, "answers")
    feed.search_answers(spark, sf_dir, "actor").write.json(path)
    return documents.read_search_documents(spark, path).select(
        "request_batch_id", "total_count", "incomplete_results", F.size("items").cast("long").alias("items"),
        "document_error").withColumn("items", F.when(F.col("items") >= 0, F.col("items")))


@query("a7_read_detail_documents", X.lookups("actor", """
SELECT detail_id AS request_batch_id, CASE WHEN g % 8 IN (1, 2, 3) THEN found END AS error_code,
  CASE WHEN g % 8 IN (1, 2, 3) THEN said END AS error_message FROM y""", X.DETAILS))
def a7(spark, sf_dir):
    path = _folder(spark, "details")
    feed.detail_answers(spark, sf_dir, "actor").write.json(path)
    return documents.read_detail_documents(spark, path).select("request_batch_id", "error_code", "error_message")


@query("a8_stream_pages", X.deliveries("""
SELECT run_id, CAST(count(DISTINCT page_no) AS BIGINT) AS pages FROM d GROUP BY run_id"""))
def a8(spark, sf_dir):
    landing, out, mark = (_folder(spark, n) for n in ("landing", "streamed", "mark"))
    feed.fetch_log(spark, sf_dir).drop("run").write.json(landing)
    stream = pages.stream_pages(spark, landing, max_files=4).select("run_id", "page_no")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("run_id string, page_no int").parquet(out).groupBy("run_id").agg(
        F.count("*").alias("pages"))


_STORED = f"""
SELECT ref, count(*) AS events, CAST(max(seq) AS BIGINT) AS last_seq FROM pushes GROUP BY ref"""


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("ref").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


@query("a9_append_log", f"WITH {X.PUSHES} {_STORED}")
def a9(spark, sf_dir):
    root = _folder(spark, "log")
    rows = feed.push_events(spark, sf_dir)
    older, newer = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    tables.append_log(older, root, "push_events", 0)
    tables.append_log(newer, root, "push_events", 1)
    tables.append_log(newer, root, "push_events", 1)
    return _summary(tables.read_log(spark, root, "push_events"))


@query("a9_read_before_batch", f"WITH {X.PUSHES} {_STORED.replace('FROM pushes', 'FROM pushes WHERE seq % 2 = 0')}")
def a9_before(spark, sf_dir):
    root = _folder(spark, "log")
    rows = feed.push_events(spark, sf_dir)
    tables.append_log(rows.where("seq % 2 = 0"), root, "push_events", 0)
    tables.append_log(rows.where("seq % 2 = 1"), root, "push_events", 1)
    return _summary(tables.read_log(spark, root, "push_events", before=1))


@query("a10_swap_snapshot", X.state("""
SELECT enrichment_status, count(*) AS n FROM actor WHERE g % 2 = 0 GROUP BY 1"""))
def a10(spark, sf_dir):
    root = _folder(spark, "snapshots")
    actors = feed.entities(spark, sf_dir, "actor")
    tables.swap_snapshot(actors, root, "actors", 0)
    tables.swap_snapshot(actors.where("github_id % 2 = 0"), root, "actors", 1)
    return tables.read_snapshot(spark, root, "actors").groupBy("enrichment_status").agg(F.count("*").alias("n"))


@query("a10_read_before_batch", X.state("SELECT enrichment_status, count(*) AS n FROM actor GROUP BY 1"))
def a10_before(spark, sf_dir):
    root = _folder(spark, "snapshots")
    actors = feed.entities(spark, sf_dir, "actor")
    tables.swap_snapshot(actors, root, "actors", 0)
    tables.swap_snapshot(actors.where("github_id % 2 = 0"), root, "actors", 1)
    return tables.read_snapshot(spark, root, "actors", before=1).groupBy("enrichment_status").agg(
        F.count("*").alias("n"))


@query("a9_old_batch_refused", f"WITH {X.PUSHES} {_STORED.replace('FROM pushes', 'FROM pushes WHERE seq % 2 = 1')}")
def a9_refused(spark, sf_dir):
    """A batch older than the newest adds nothing."""
    root = _folder(spark, "log")
    rows = feed.push_events(spark, sf_dir)
    tables.append_log(rows.where("seq % 2 = 1"), root, "push_events", 1)
    try:
        tables.append_log(rows.where("seq % 2 = 0"), root, "push_events", 0)
    except commits.BatchRefused:
        pass
    return _summary(tables.read_log(spark, root, "push_events"))


@query("a10_crash_before_pointer", X.state("""
SELECT v.label, enrichment_status, count(*) AS n FROM actor, (VALUES ('live'), ('before batch 2')) v(label) GROUP BY 1, 2
UNION ALL SELECT 'after', enrichment_status, count(*) FROM actor WHERE g % 2 = 0 GROUP BY 2"""))
def a10_crash(spark, sf_dir):
    """Rows written but never committed are in no view; a later batch that commits is."""
    root = _folder(spark, "snapshots")
    actors = feed.entities(spark, sf_dir, "actor")
    tables.swap_snapshot(actors, root, "actors", 0)
    commits.Transaction(spark, root, 1).replace(actors.where("github_id % 3 = 0"), "actors")

    def view(label: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy("enrichment_status").agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "enrichment_status", "n")

    crashed = [view("live", tables.read_snapshot(spark, root, "actors")),
               view("before batch 2", tables.read_snapshot(spark, root, "actors", before=2))]
    tables.swap_snapshot(actors.where("github_id % 2 = 0"), root, "actors", 2)
    return crashed[0].unionByName(crashed[1]).unionByName(view("after", tables.read_snapshot(spark, root, "actors")))


@query("a10_touched_buckets", X.state("""
SELECT enrichment_status, count(*) AS n, count(*) FILTER (WHERE g % 50 = 0) AS changed FROM actor GROUP BY 1"""))
def a10_touched(spark, sf_dir):
    """Some entities change and only their buckets are written; all the others are carried over."""
    root = _folder(spark, "snapshots")
    actors = feed.entities(spark, sf_dir, "actor")
    tables.swap_snapshot(actors.withColumn("lease_token", F.lit(None).cast("string")), root, "actors", 0)
    tx = commits.Transaction(spark, root, 1)
    own = tx.touched("actors", actors.where("github_id % 50 = 0"), "github_id")
    token = F.when(F.col("github_id") % 50 == 0, F.lit("changed"))
    tx.replace(tx.rows("actors", own).withColumn("lease_token", token), "actors", own)
    tx.commit()
    return tables.read_snapshot(spark, root, "actors").groupBy("enrichment_status").agg(
        F.count("*").alias("n"), F.count("lease_token").alias("changed"))


@query("c1_known_ids", f"""WITH {X.PUSHES}
SELECT ref, count(*) AS events, count(*) FILTER (WHERE seq % 3 <> 0) AS known FROM pushes GROUP BY ref""")
def c1_known_ids(spark, sf_dir):
    """Two of three events are stored, in six batches; the index tells which of all events those are."""
    root = _folder(spark, "ids")
    rows = feed.push_events(spark, sf_dir)
    for batch in range(6):
        tx = commits.Transaction(spark, root, batch)
        known_ids.remember(tx, rows.where((F.col("seq") % 3 != 0) & (F.col("seq") % 6 == batch)))
        tx.commit()
    known = known_ids.stored_among(commits.Transaction(spark, root, 6), rows.select("github_event_id"))
    return rows.join(known.withColumn("known", F.lit(1)), "github_event_id", "left").groupBy("ref").agg(
        F.count("*").alias("events"), F.count("known").alias("known"))


@query("a11_write_report", X.state("""
SELECT '{"github_id":' || g || ',"last_error":' || CASE WHEN last_error IS NULL THEN 'null' ELSE '"' || last_error || '"' END || '}' AS value
FROM actor"""))
def a11(spark, sf_dir):
    path = _folder(spark, "report")
    tables.write_report(feed.entities(spark, sf_dir, "actor").select("github_id", "last_error"), path)
    return spark.read.text(path)


@query("a12_check_constraints", X.state("""
SELECT 'push_events' AS table_name, 'github_event_id_unique' AS rule, count(*) AS broken FROM pushes WHERE n % 50 = 0 HAVING count(*) > 0
UNION ALL SELECT 'push_events', 'github_actor_id_references_actors', count(*) + count(*) FILTER (WHERE n % 50 = 0)
  FROM pushes WHERE actor_id % 11 = 0 HAVING count(*) > 0
UNION ALL SELECT 'actors', 'enrichment_attempts_nonnegative', count(*) FROM actor WHERE g % 4 = 3 HAVING count(*) > 0
UNION ALL SELECT 'actors', 'enrichment_stage_known', count(*) FROM actor WHERE enrichment_stage = 'terminal' HAVING count(*) > 0
UNION ALL SELECT 'actors', 'current_batch_id_references_batches', count(*) FROM actor WHERE leased_until IS NOT NULL AND g % 10 = 7 HAVING count(*) > 0
""", X.PUSHES))
def a12(spark, sf_dir):
    events = feed.push_events(spark, sf_dir)
    events = events.unionByName(events.where("github_push_id % 50 = 0"))
    actors = feed.entities(spark, sf_dir, "actor")
    broken = actors.withColumn("enrichment_attempts", F.when(
        F.col("github_id") % 4 == 3, -1).otherwise(F.col("enrichment_attempts"))).withColumn(
        "enrichment_stage", F.regexp_replace("enrichment_stage", "terminal", "gone"))
    batches = feed.batches(spark, sf_dir).where("correlation_id <> 'batch-7'")
    related = {"actors": actors.where("github_id % 11 <> 0"),
               "repositories": feed.entities(spark, sf_dir, "repository"), "batches": batches}
    found = tables.check_constraints(events, "push_events", related).unionByName(
        tables.check_constraints(broken, "actors", related))
    return found.groupBy("table_name", "rule").agg(F.count("*").alias("broken"))


# --- B -----------------------------------------------------------------------------------

_PLACE = ("run_id", "page_no", "pos")


@query("b1_envelope_id", X.deliveries("SELECT run_id, page_no, pos, id AS github_event_id FROM d"))
def b1(spark, sf_dir):
    return _checked(spark, sf_dir).select(*_PLACE, F.col("n_event_id").alias("github_event_id"))


@query("b2_envelope_type", X.deliveries("SELECT run_id, page_no, pos, type AS event_type FROM d"))
def b2(spark, sf_dir):
    return _checked(spark, sf_dir).select(*_PLACE, F.col("n_type").alias("event_type"))


@query("b3_route", X.deliveries("""
SELECT CASE WHEN type IS NULL THEN 'missing_event_type' WHEN type = 'WatchEvent' THEN 'ignored' ELSE 'process' END AS route,
  count(*) AS n FROM d GROUP BY 1"""))
def b3(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))


@query("b5_normalize_actor", X.deliveries("""
SELECT run_id, page_no, pos, actor_id AS github_id, login, display_login, avatar_url
FROM d WHERE outcome = 'push_event'"""))
def b5(spark, sf_dir):
    return _pushes(spark, sf_dir, "actor").select(
        *_PLACE, "actor.github_id", "actor.login", "actor.display_login", "actor.avatar_url")


@query("b6_normalize_repository", X.deliveries("""
SELECT run_id, page_no, pos, repo_id AS github_id, full_name, repo_name AS name, owner_login
FROM d WHERE outcome = 'push_event'"""))
def b6(spark, sf_dir):
    return _pushes(spark, sf_dir, "repository").select(
        *_PLACE, "repository.github_id", "repository.full_name", "repository.name", "repository.owner_login")


@query("b7_normalize_occurred_at", X.deliveries(f"""
SELECT run_id, page_no, pos, CASE WHEN n % 61 <> 0 THEN {X.iso('ts')} END AS occurred_at FROM d"""))
def b7(spark, sf_dir):
    return _checked(spark, sf_dir).select(*_PLACE, iso8601(F.col("n_occurred_at")).alias("occurred_at"))


@query("b8_normalize_payload", X.deliveries("""
SELECT run_id, page_no, pos, CASE WHEN n % 593 <> 0 THEN n END AS push_id,
  CASE WHEN n % 53 <> 0 THEN 'refs/heads/' || event_type END AS ref,
  repo_id + CASE WHEN n % 31 = 0 THEN 1 ELSE 0 END AS repository_id FROM d"""))
def b8(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        *_PLACE, F.col("n_payload_push_id").alias("push_id"), F.col("n_payload_ref").alias("ref"),
        F.col("n_payload_repository_id").alias("repository_id"))


@query("b9_sha_ok", X.deliveries("""
SELECT run_id, page_no, pos, n % 29 <> 0 AND n % 37 <> 0 AS head_ok, true AS before_ok FROM d"""))
def b9(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        *_PLACE, B.sha_ok(F.col("s_payload_head")).alias("head_ok"), B.sha_ok(F.col("s_payload_before")).alias("before_ok"))


@query("b10_integrity", X.deliveries("""
SELECT count(*) AS mismatches FROM d WHERE type = 'PushEvent' AND n % 31 = 0"""))
def b10(spark, sf_dir):
    broken = _checked(spark, sf_dir).select(F.explode(B.violations()).alias("v"))
    return broken.where("v.code = 'repository_id_mismatch'").agg(F.count("*").alias("mismatches"))


@query("b11_violations", X.deliveries("""
SELECT code, count(*) AS n FROM (
  SELECT unnest(list_filter([
    CASE WHEN id IS NULL THEN 'missing_event_id' END, CASE WHEN n % 47 = 0 THEN 'invalid_actor_reference' END,
    CASE WHEN n % 61 = 0 THEN 'invalid_occurred_at' END,
    CASE WHEN n % 53 = 0 OR n % 29 = 0 THEN 'missing_required_field' END,
    CASE WHEN n % 593 = 0 THEN 'identifier_out_of_range' END,
    CASE WHEN n % 37 = 0 AND n % 29 <> 0 THEN 'invalid_field_format' END,
    CASE WHEN n % 31 = 0 THEN 'repository_id_mismatch' END], lambda x: x IS NOT NULL)) AS code
  FROM d WHERE type = 'PushEvent') GROUP BY code"""))
def b11(spark, sf_dir):
    return (_checked(spark, sf_dir).select(F.explode(B.violations()).alias("v"))
            .groupBy(F.col("v.code").alias("code")).agg(F.count("*").alias("n")))


@query("b12_payload_fingerprint", X.deliveries(f"""
SELECT run_id, page_no, pos, sha256({X.CANONICAL}) AS payload_fingerprint FROM d"""))
def b12(spark, sf_dir):
    rows = B.read_fields(envelopes(spark, sf_dir))
    return rows.select(*_PLACE, B.payload_fingerprint(F.col("canonical_text"), F.col("undefined"))
                       .alias("payload_fingerprint"))


@query("b13_describe", X.deliveries(f"""
SELECT run_id, page_no, pos, {X.MESSAGE} AS error_message FROM d WHERE outcome = 'quarantined'"""))
def b13(spark, sf_dir):
    return landed(spark, sf_dir, (*_PLACE, "outcome", "error_message")).where("outcome = 'quarantined'").select(*_PLACE, "error_message")


@query("b14_taxonomy", X.deliveries("""
SELECT CASE WHEN code IN ('missing_required_field', 'invalid_field_format', 'identifier_out_of_range') THEN 'missing_required_field'
            WHEN code = 'repository_id_mismatch' THEN 'integrity_failure' ELSE 'invalid_envelope' END AS reason_group,
  count(*) AS n FROM d WHERE outcome = 'quarantined' GROUP BY 1"""))
def b14(spark, sf_dir):
    return (landed(spark, sf_dir, ("outcome", "error_code")).where("outcome = 'quarantined'")
            .groupBy(B.taxonomy_group(F.col("error_code")).alias("reason_group")).agg(F.count("*").alias("n")))


@query("b15_storable", X.deliveries("""
SELECT CASE WHEN outcome = 'ignored' THEN 'ignored' WHEN n % 97 = 0 THEN 'failed'
            WHEN n % 89 = 0 AND outcome = 'quarantined' THEN 'failed' ELSE outcome END AS outcome, count(*) AS n
FROM d GROUP BY 1"""))
def b15(spark, sf_dir):
    rows = feed.deliveries(spark, sf_dir)
    spoilt = F.when(F.col("n") % 97 == 0, F.lit('"public":"a\\u0000b"')).when(
        F.col("n") % 89 == 0, F.lit('"public":1e400')).otherwise(F.lit('"public":true'))
    body = F.concat(F.lit("["), F.replace(F.col("envelope"), F.lit('"public":true'), spoilt), F.lit("]"))
    landed = rows.select(F.col("n").cast("string").alias("run_id"), "page_no", F.col("ts").alias("received_at"),
                         body.alias("body"))
    return B.classify(pages.explode_envelopes(landed)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("b16_classify", X.deliveries("""
SELECT run_id, outcome, type AS event_type, code AS error_code, count(*) AS n FROM d GROUP BY 1, 2, 3, 4"""))
def b16(spark, sf_dir):
    return (classified(spark, sf_dir).groupBy("run_id", "outcome", "event_type", "error_code")
            .agg(F.count("*").alias("n")))


# --- C -----------------------------------------------------------------------------------


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.push_events(spark, sf_dir).where("github_push_id % 9 = 0").select("github_event_id")


_NEW = """
known AS (SELECT CAST(58000000000 + event_id AS VARCHAR) AS id FROM events WHERE event_type <> 'view' AND event_id % 9 = 0),
fresh AS (SELECT * FROM created WHERE id NOT IN (SELECT id FROM known))"""


@query("c1_dedup_new", X.deliveries(f"""
SELECT id AS github_event_id, run_id, page_no, pos, {X.micros('received_at')} AS received_at FROM fresh""", X.CREATED, _NEW))
def c1(spark, sf_dir):
    new = dedup.dedup_new(landed(spark, sf_dir, RESULT_COLUMNS), _known(spark, sf_dir))
    return new.select("github_event_id", *_PLACE, iso8601_micros(F.col("received_at")).alias("received_at"))


@query("c1_delivery_results", X.deliveries("""
SELECT d.run_id, CASE WHEN d.outcome <> 'push_event' THEN d.outcome WHEN f.id IS NOT NULL THEN 'created' ELSE 'duplicate' END AS result,
  count(*) AS n FROM d LEFT JOIN fresh f ON d.id = f.id AND d.run_id = f.run_id AND d.page_no = f.page_no AND d.pos = f.pos
  AND d.outcome = 'push_event' GROUP BY 1, 2""", X.CREATED, _NEW))
def c1_results(spark, sf_dir):
    rows = landed(spark, sf_dir, RESULT_COLUMNS)
    known = _known(spark, sf_dir)
    return (dedup.delivery_results(rows, dedup.dedup_new(rows, known), known)
            .groupBy("run_id", "result").agg(F.count("*").alias("n")))


@query("c2_quarantine_merge", X.deliveries(f"""
SELECT sha256({X.CANONICAL}) AS payload_fingerprint, any_value(id) AS github_event_id, any_value(code) AS error_code,
  count(*) AS occurrence_count, {X.micros('min(received_at)')} AS first_received_at, {X.micros('max(received_at)')} AS last_received_at
FROM d WHERE outcome = 'quarantined' GROUP BY 1"""))
def c2(spark, sf_dir):
    rows = landed(spark, sf_dir, MERGE_COLUMNS)
    old = dedup.quarantine_merge(rows.where("page_no < 11"))
    merged = dedup.quarantine_merge(rows.where("page_no = 11"), old)
    return merged.select("payload_fingerprint", "github_event_id", "error_code", "occurrence_count",
                         iso8601_micros(F.col("first_received_at")).alias("first_received_at"),
                         iso8601_micros(F.col("last_received_at")).alias("last_received_at"))


def _pushes(spark, sf_dir, kind):
    return landed(spark, sf_dir, (*ARRIVAL, "outcome", kind)).where("outcome = 'push_event'")


def _created(spark, sf_dir, *columns):
    return dedup.dedup_new(landed(spark, sf_dir, (*RESULT_COLUMNS, *columns)))


@query("c3_actor_identity_fold", X.deliveries(f"""
SELECT actor_id AS github_id, any_value(login) AS login, any_value(display_login) AS display_login,
  any_value(avatar_url) AS avatar_url, {X.micros('min(received_at)')} AS created_at, {X.micros('max(received_at)')} AS updated_at
FROM d WHERE outcome = 'push_event' GROUP BY 1"""))
def c3(spark, sf_dir):
    folded = folds.identity_fold("actor", folds.observations_of("actor", _pushes(spark, sf_dir, "actor")))
    return folded.select("github_id", "login", "display_login", "avatar_url",
                         *[iso8601_micros(F.col(c)).alias(c) for c in ("created_at", "updated_at")])


@query("c4_repository_identity_fold", X.deliveries(f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY received_at DESC, run_id DESC, page_no DESC, pos DESC) AS latest
  FROM d WHERE outcome = 'push_event')
SELECT repo_id AS github_id, max(full_name) FILTER (WHERE latest = 1) AS full_name, max(repo_name) FILTER (WHERE latest = 1) AS name,
  max(owner_login) FILTER (WHERE latest = 1) AS owner_login, {X.micros('max(received_at)')} AS updated_at FROM ranked GROUP BY 1"""))
def c4(spark, sf_dir):
    folded = folds.identity_fold("repository", folds.observations_of("repository", _pushes(spark, sf_dir, "repository")))
    return folded.select("github_id", "full_name", "name", "owner_login", iso8601_micros(F.col("updated_at")).alias("updated_at"))


@query("c4_identity_fold_over_stored", X.deliveries(f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY received_at DESC, run_id DESC, page_no DESC, pos DESC) AS latest
  FROM d WHERE outcome = 'push_event'),
late AS (SELECT repo_id, max(full_name) FILTER (WHERE latest = 1) AS full_name, max(received_at) AS t FROM ranked GROUP BY 1)
SELECT coalesce(repository.g, late.repo_id) AS github_id,
  CASE WHEN repository.g IS NULL OR late.t >= repository.updated_at THEN coalesce(late.full_name, identifier) ELSE identifier END AS full_name,
  {X.micros('greatest(late.t, repository.updated_at)')} AS updated_at
FROM repository FULL JOIN late ON repository.g = late.repo_id""", X.entity_cte("repository")))
def c4_stored(spark, sf_dir):
    observed = folds.observations_of("repository", _pushes(spark, sf_dir, "repository"))
    folded = folds.identity_fold("repository", observed, feed.entities(spark, sf_dir, "repository"))
    return folded.select("github_id", "full_name", iso8601_micros(F.col("updated_at")).alias("updated_at"))


@query("c5_activity_fold", X.deliveries(f"""
SELECT actor_id AS github_id, {X.micros('min(received_at)')} AS first_seen_at, {X.micros('max(received_at)')} AS last_seen_at,
  {X.micros('max(occurred_at)')} AS latest_event_at FROM created GROUP BY 1""", X.CREATED))
def c5(spark, sf_dir):
    created = _created(spark, sf_dir, "actor", "push")
    return folds.activity_fold("actor", created).select("github_id", *[
        iso8601_micros(F.col(c)).alias(c) for c in ("first_seen_at", "last_seen_at", "latest_event_at")])


@query("c6_stage_instants_keep_first", X.deliveries(f"""
, seen AS (SELECT repo_id, min(received_at) AS t FROM created GROUP BY 1)
SELECT coalesce(repository.g, seen.repo_id) AS github_id, {X.micros('coalesce(repository.created_at, seen.t)')} AS event_native_at,
  {X.micros('coalesce(repository.created_at, seen.t)')} AS batch_pending_at
FROM repository FULL JOIN seen ON repository.g = seen.repo_id""", X.CREATED, X.entity_cte("repository")))
def c6(spark, sf_dir):
    created = _created(spark, sf_dir, "repository", "push")
    return folds.activity_fold("repository", created, feed.entities(spark, sf_dir, "repository")).select(
        "github_id", *[iso8601_micros(F.col(c)).alias(c) for c in ("event_native_at", "batch_pending_at")])


@query("c7_event_observations", X.deliveries(f"""
SELECT 'actor' AS entity_kind, actor_id AS entity_github_id, id AS github_event_id, sha256({X.ACTOR_TEXT}) AS payload_fingerprint FROM created
UNION ALL SELECT 'repository', repo_id, id, sha256({X.REPO_TEXT}) FROM created""", X.CREATED))
def c7(spark, sf_dir):
    created = _created(spark, sf_dir, "push", "actor_fragment", "repo_fragment")
    return evidence.event_observations(created).select(
        "entity_kind", "entity_github_id", "github_event_id", "payload_fingerprint")


@query("c8_new_entity_rows", X.deliveries(f"""
SELECT actor_id AS github_id, 'pending' AS enrichment_status, 'batch_pending' AS enrichment_stage, CAST(0 AS INTEGER) AS enrichment_attempts,
  {X.micros('min(received_at)')} AS created_at FROM d WHERE outcome = 'push_event' AND actor_id % 3 <> 0 GROUP BY 1"""))
def c8(spark, sf_dir):
    stored = feed.entities(spark, sf_dir, "actor").where("github_id % 3 = 0")
    seen = folds.observations_of("actor", _pushes(spark, sf_dir, "actor"))
    return folds.first_sightings("actor", seen, stored).select(
        "github_id", "enrichment_status", "enrichment_stage", "enrichment_attempts",
        iso8601_micros(F.col("created_at")).alias("created_at"))


@query("c9_backfill_stage", X.state(f"""
SELECT github_id, CASE enrichment_status WHEN 'complete' THEN 'contract_complete' WHEN 'permanent_failure' THEN 'terminal'
    WHEN 'retryable_failure' THEN 'retry_scheduled' ELSE 'batch_pending' END AS enrichment_stage,
  CASE WHEN enrichment_status IN ('pending', 'retryable_failure') THEN {X.micros('first_seen_at')} END AS batch_pending_at,
  CASE WHEN enrichment_status = 'complete' THEN {X.micros('fetched_at')} END AS contract_completed_at,
  CASE WHEN enrichment_status = 'permanent_failure' THEN {X.micros('updated_at')} END AS terminal_at FROM actor"""))
def c9(spark, sf_dir):
    return upkeep.backfill_stage(feed.entities(spark, sf_dir, "actor")).select(
        "github_id", "enrichment_stage", *[iso8601_micros(F.col(c)).alias(c) for c in (
            "batch_pending_at", "contract_completed_at", "terminal_at")])


@query("c10_restore_retired_status", X.state(f"""
SELECT github_id, CASE WHEN enrichment_status <> 'retryable_failure' THEN enrichment_status ELSE 'retryable_failure' END AS enrichment_status,
  {X.micros(f"CASE WHEN enrichment_status = 'retryable_failure' AND next_retry_at > {X.NOW_SQL} THEN {X.NOW_SQL} ELSE next_retry_at END")} AS next_retry_at,
  {X.micros(f"CASE WHEN enrichment_status = 'retryable_failure' THEN greatest(updated_at, {X.NOW_SQL}) ELSE updated_at END")} AS updated_at
FROM actor"""))
def c10(spark, sf_dir):
    retired = feed.entities(spark, sf_dir, "actor").withColumn("enrichment_status", F.when(
        F.col("enrichment_status") == "retryable_failure", upkeep.RETIRED_STATUS).otherwise(F.col("enrichment_status")))
    return upkeep.restore_retired_status(retired, feed.now()).select(
        "github_id", "enrichment_status", *[iso8601_micros(F.col(c)).alias(c) for c in ("next_retry_at", "updated_at")])
