"""Feeds and tables derived from the benchmark tables.

The benchmark has no push feed, so one is built as JSON text from ``events``: a page holds
100 consecutive events, a run ten pages, and every tenth event is delivered again on the
run's eleventh page. Defects are planted by remainders of the event id, so the expected
outcome of every delivery can also be computed from the plain columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedledger import schemas as S
from feedledger.sources.documents import ANSWER_LOG
from feedledger.session import configure

# All reports are taken as of this instant, just after the last event.
NOW = "2024-01-31 00:00:00"
PAGE, RUN, REPOSITORIES = 100, 1000, 400
TASK_EVENTS = 10_000  # a task builds and classifies about so many events

# What is wrong with event n when n leaves no remainder.
DEFECTS = {
    "no_id": 41, "no_type": 43, "blank_login": 47, "no_ref": 53, "bad_date": 61, "no_head": 29,
    "bad_head": 37, "other_repository": 31, "wide_push_id": 593,
}


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _planted(defect: str) -> str:
    return f"n % {DEFECTS[defect]} = 0"


ENVELOPE_SQL = f"""concat('{{',
  CASE WHEN {_planted('no_id')} THEN '' ELSE concat('"id":"', 58000000000 + n, '",') END,
  CASE WHEN {_planted('no_type')} THEN ''
       ELSE concat('"type":"', CASE WHEN event_type = 'view' THEN 'WatchEvent' ELSE 'PushEvent' END, '",') END,
  '"actor":{{"id":', user_id + 1, ',"login":"', CASE WHEN {_planted('blank_login')} THEN '' ELSE concat('user', user_id) END, '"',
  CASE WHEN n % 2 = 0 THEN concat(',"display_login":"user', user_id, '"') ELSE '' END,
  ',"avatar_url":"https://avatars.example.org/', user_id, '"}},',
  '"repo":{{"id":', 1000 + n % {REPOSITORIES}, ',"name":"org', n % 7, '/repo', n % {REPOSITORIES}, '"}},',
  '"payload":{{"repository_id":', 1000 + n % {REPOSITORIES} + CASE WHEN {_planted('other_repository')} THEN 1 ELSE 0 END,
  ',"push_id":', CASE WHEN {_planted('wide_push_id')} THEN '9223372036854775808' ELSE cast(n AS STRING) END,
  ',"ref":', CASE WHEN {_planted('no_ref')} THEN 'null' ELSE concat('"refs/heads/', event_type, '"') END,
  CASE WHEN {_planted('no_head')} THEN '' WHEN {_planted('bad_head')} THEN ',"head":"zz"'
       ELSE concat(',"head":"', md5(cast(n AS STRING)), substr(md5(cast(n AS STRING)), 1, 8), '"') END,
  ',"before":"', sha2(cast(n AS STRING), 256), '"}},"public":true,"created_at":"',
  CASE WHEN {_planted('bad_date')} THEN date_format(ts, 'yyyy-MM-dd')
       ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") END, '"}}')"""


def _by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their ``run``, those of one run together.

    The narrow rows are dealt before any text is made of them: a large row group would be one task's work
    otherwise, and all envelopes would be shuffled to meet their page. Tasks are as many as events ask for.
    """
    rows = events(spark, sf_dir).withColumn("run", F.floor(F.col("n") / RUN).cast("long"))
    return rows.repartition(max(spark.sparkContext.defaultParallelism, rows.count() // TASK_EVENTS), "run")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery of every event as envelope text, with its page."""
    pages = F.when(F.col("n") % 10 == 0, F.array(
        (F.lit(1) + F.floor(F.col("n") / PAGE) % 10).cast("int"), F.lit(11))).otherwise(
        F.array((F.lit(1) + F.floor(F.col("n") / PAGE) % 10).cast("int")))
    return _by_run(spark, sf_dir).select(
        "n", "ts", F.expr(ENVELOPE_SQL).alias("envelope"), "run", F.explode(pages).alias("page_no"))


def run_id(run):
    return F.format_string("run-%08d", run)


def page_url(page):
    return F.concat(F.lit("https://api.example.org/events?per_page=100&page="), page.cast("string"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed pages. A page gathers at most 100 deliveries by construction."""
    grouped = deliveries(spark, sf_dir).groupBy("run", "page_no").agg(
        F.max("ts").alias("ts"), F.sort_array(F.collect_list(F.struct("n", "envelope"))).alias("rows"))
    late = F.when(F.col("page_no") == 11, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 60 SECONDS"))
    received = F.col("ts") + late
    used = F.col("page_no") + F.col("run") % 3
    headers = F.map_from_arrays(
        F.array(*[F.lit(h) for h in ("Link", "X-RateLimit-Resource", "X-RateLimit-Limit", "X-RateLimit-Remaining",
                                     "X-RateLimit-Used", "X-RateLimit-Reset", "X-Poll-Interval", "ETag")]),
        F.array(
            F.when(F.col("page_no") < 11, F.concat(
                F.lit("<"), page_url(F.col("page_no") + 1), F.lit('>; rel="next", <https://api.example.org/events?page=11>; rel="last"'))),
            F.lit("core"), F.lit("60"), (F.lit(60) - used).cast("string"), used.cast("string"),
            (F.unix_timestamp(F.date_trunc("day", "received_at")) + 86400).cast("string"),
            F.lit("60"), F.concat(F.lit('W/"'), F.col("run").cast("string"), F.lit('"'))))
    return grouped.withColumn("received_at", received).select(
        run_id(F.col("run")).alias("run_id"), (F.col("run") % 5).alias("source_id"), "page_no",
        page_url(F.col("page_no")).alias("request_url"), "received_at", F.lit(200).alias("status"),
        headers.alias("headers"),
        F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["envelope"]), ","), F.lit("]")).alias("body"),
        "run")


def walk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed pages with walks that end early: an unusable page, an empty one, a link
    back, a missing link."""
    run, page = F.col("run"), F.col("page_no")
    body = (F.when((run % 5 == 1) & (page == 4), F.lit('{"message":"try later"}'))
            .when((run % 5 == 2) & (page == 6), F.lit(" [ ] ")).otherwise(F.col("body")))
    link = (F.when((run % 5 == 3) & (page == 5), F.concat(F.lit("<"), page_url(F.lit(2)), F.lit('>; rel="next"')))
            .when((run % 5 == 4) & (page == 7), F.lit("")).otherwise(F.col("headers")["Link"]))
    return fetch_log(spark, sf_dir).withColumn("body", body).withColumn(
        "headers", F.create_map(F.lit("LINK"), link))


# --- derived state -----------------------------------------------------------------------


def push_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but views as a stored push event."""
    n = F.col("n")
    return events(spark, sf_dir).where("event_type <> 'view'").select(
        (n + 1).alias("seq"), (F.lit(58000000000) + n).cast("string").alias("github_event_id"),
        n.alias("github_push_id"), (F.lit(1000) + n % REPOSITORIES).alias("github_repository_id"),
        (F.col("user_id") + 1).alias("github_actor_id"),
        F.concat(F.lit("refs/heads/"), F.col("event_type")).alias("ref"),
        F.sha2(n.cast("string"), 256).alias("head_sha"), F.sha2(F.concat(F.lit("b"), n.cast("string")), 256).alias("before_sha"),
        F.date_trunc("hour", "ts").alias("occurred_at"), F.to_json(F.struct("n", "event_type")).alias("raw_payload"),
        (F.col("ts") + F.expr("INTERVAL 60 SECONDS")).alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 60 SECONDS")).alias("updated_at"))


# Status, stage and instants of an entity as functions of its id ``g`` and of the first and
# last event that names it (``t0``, ``t1``). The same text runs in Spark and in the oracle.
STATE_SQL = {
    "enrichment_status": "CASE g % 5 WHEN 1 THEN 'complete' WHEN 2 THEN 'retryable_failure' "
                         "WHEN 3 THEN 'permanent_failure' ELSE 'pending' END",
    "enrichment_stage": "CASE g % 5 WHEN 1 THEN CASE WHEN g % 7 = 0 THEN 'batch_in_flight' ELSE 'contract_complete' END "
                        "WHEN 2 THEN CASE WHEN g % 4 = 0 THEN 'detail_in_flight' ELSE 'retry_scheduled' END "
                        "WHEN 3 THEN 'terminal' ELSE CASE g % 3 WHEN 0 THEN 'batch_pending' "
                        "WHEN 1 THEN 'batch_in_flight' ELSE 'detail_pending' END END",
}
_HOURS = {
    "next_retry_at": ("g % 5 = 2 AND g % 2 = 0", "g % 7 - 3"),
    "leased_until": ("(g % 5 = 1 AND g % 7 = 0) OR (g % 5 = 2 AND g % 4 = 0) OR (g % 5 IN (0, 4) AND g % 3 = 1)", "g % 5 - 2"),
    "fetched_at": ("g % 5 = 1", "0 - g % 72"),
    "contract_completed_at": ("g % 5 = 1", "0 - g % 6"),
    "terminal_at": ("g % 5 = 3", "0 - g % 4"),
}


def instants_sql(hours: str) -> dict[str, str]:
    """Instant columns; ``hours`` is how the engine writes NOW plus a number of hours."""
    return {name: f"CASE WHEN {test} THEN {hours.format(amount)} END" for name, (test, amount) in _HOURS.items()}


SPARK_HOURS = f"(TIMESTAMP'{NOW}' + make_interval(0, 0, 0, 0, cast({{0}} AS INT), 0, 0))"


def _with_state(found: DataFrame, kind: str) -> DataFrame:
    state = {**STATE_SQL, **instants_sql(SPARK_HOURS)}
    flight = state["leased_until"]
    exprs = {
        "seq": "g", "github_id": "g", "api_url": f"concat('https://api.example.org/{kind}/', g)",
        "first_seen_at": "t0", "last_seen_at": "t1", "latest_event_at": "t1", "event_native_at": "t0",
        "derived_at": "t0", "batch_pending_at": "t0", "created_at": "t0", "updated_at": "t1",
        "detail_pending_at": "CASE WHEN g % 5 = 2 AND g % 4 = 0 OR g % 5 IN (0, 4) AND g % 3 = 2 THEN t1 END",
        "enrichment_attempts": "cast(g % 4 AS INT)", "detail_attempts": "cast(g % 3 AS INT)",
        "lease_token": f"CASE WHEN {flight} IS NOT NULL THEN concat('lease-', g) END",
        "current_batch_id": f"CASE WHEN {flight} IS NOT NULL THEN concat('batch-', g % 10) END",
        "last_error": "CASE WHEN g % 5 = 2 THEN 'server_error' END", **state,
        **({"login": "concat('user', g - 1)"} if kind == "actor" else
           {"full_name": "concat('org', g % 7, '/repo', g - 1000)", "name": "concat('repo', g - 1000)"}),
    }
    return found.select(*[
        F.expr(exprs.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in S.ENTITY_TABLES[kind].fields])


def entities(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Actor or repository rows of the stored push events, with made-up enrichment state."""
    key = F.col("user_id") + 1 if kind == "actor" else F.lit(1000) + F.col("n") % REPOSITORIES
    found = (events(spark, sf_dir).where("event_type <> 'view'")
             .groupBy(key.alias("g")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")))
    return _with_state(found, kind)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One past request per ten events."""
    grouped = events(spark, sf_dir).groupBy(F.floor(F.col("n") / 10).cast("long").alias("b")).agg(
        F.count("*").alias("asked"), F.count_if(F.col("value") > 5).alias("got"),
        F.count_if(F.col("value") > 20).alias("good"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    exprs = {
        "correlation_id": "concat('batch-', b)",
        "request_kind": "CASE WHEN b % 3 = 0 THEN 'detail' ELSE 'search' END",
        "entity_kind": "CASE WHEN b % 3 = 0 THEN 'actor' WHEN b % 2 = 0 THEN 'actor' ELSE 'repository' END",
        "status": "element_at(array('in_flight','succeeded','succeeded','failed','deferred','stale_lease'), cast(b % 6 AS INT) + 1)",
        "requested_count": "asked", "returned_count": "got", "valid_count": "good",
        "missing_count": "asked - got", "invalid_count": "got - good", "total_count": "got",
        "incomplete_results": "CASE WHEN b % 8 = 0 THEN true WHEN b % 8 = 1 THEN false END",
        "rate_limit_resource": "CASE WHEN b % 6 IN (1, 2) THEN CASE WHEN b % 3 = 0 THEN 'core' ELSE 'search' END END",
        "rate_limit_limit": "CASE WHEN b % 3 = 0 THEN 60 ELSE 10 END",
        "rate_limit_remaining": "CASE WHEN b % 3 = 0 THEN 60 - b % 50 ELSE 10 - b % 10 END",
        "rate_limit_used": "CASE WHEN b % 3 = 0 THEN b % 50 ELSE b % 10 END",
        "rate_limit_reset_at": "date_trunc('day', t0) + INTERVAL 1 DAY",
        "started_at": "t0", "completed_at": "CASE WHEN b % 6 <> 0 THEN t1 END", "created_at": "t0", "updated_at": "t1",
    }
    return grouped.select(*[F.expr(exprs.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in S.BATCHES.fields])


def ingestion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One past run per 100 events."""
    grouped = events(spark, sf_dir).groupBy(F.floor(F.col("n") / 100).cast("long").alias("b")).agg(
        F.count("*").alias("seen"), F.count_if(F.col("event_type") != "view").alias("pushed"),
        F.count_if((F.col("event_type") != "view") & (F.col("value") > 10)).alias("made"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    exprs = {
        "run_id": "concat('run-', lpad(cast(b AS STRING), 8, '0'))", "source_id": "b % 5",
        "status": "element_at(array('completed','completed','not_modified','failed','deferred','running'), cast(b % 6 AS INT) + 1)",
        "started_at": "t0", "completed_at": "CASE WHEN b % 6 <> 5 THEN date_trunc('hour', t1) END",
        "pages_fetched": "1", "events_received": "seen", "push_events_seen": "pushed", "events_created": "made",
        "duplicates_skipped": "pushed - made", "events_quarantined": "0", "events_failed": "0",
    }
    return grouped.select(*[F.expr(exprs.get(f.name, "NULL")).cast(f.dataType).alias(f.name)
                            for f in S.INGESTION_RUNS.fields])


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as their runs left them: one per remainder of the run number."""
    grouped = ingestion_runs(spark, sf_dir).groupBy(F.col("source_id").alias("s")).agg(
        F.max("started_at").alias("t1"), F.count_if(F.col("status") == "failed").alias("f"))
    exprs = {
        "id": "s", "source_type": "CASE WHEN s = 3 THEN 'fixture_events' ELSE 'public_events' END",
        "enabled": "s <> 4", "status": "CASE WHEN s = 2 THEN 'failed' ELSE 'idle' END",
        "consecutive_failures": "f", "last_polled_at": "t1", "last_success_at": "t1",
        "cadence_due_at": "t1 + INTERVAL 300 SECONDS",
        "poll_floor_until": "CASE WHEN s % 2 = 0 THEN t1 + INTERVAL 600 SECONDS END",
        "retry_not_before_at": "CASE WHEN s = 1 THEN t1 + INTERVAL 3 DAYS END",
        "next_poll_at": "CASE WHEN s <> 0 THEN t1 + INTERVAL 300 SECONDS END",
    }
    return grouped.select(*[F.expr(exprs.get(f.name, "NULL")).cast(f.dataType).alias(f.name)
                            for f in S.EVENT_SOURCES.fields])


def core_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core quota ledger after all runs."""
    grouped = ingestion_runs(spark, sf_dir).agg(F.count("*").alias("runs"), F.max("started_at").alias("t1"))
    exprs = {
        "id": "1", "resource": "'core'", "window_status": "'active'", "limit": "60", "remaining": "60 - runs % 50",
        "reset_at": "date_trunc('hour', t1) + INTERVAL 1 HOUR", "observed_at": "t1", "window_initialized_at": "t1",
        "reserve": "8", "global_blocked_until": "NULL", "poll_used": "12 + runs % 3", "poll_allowance": "12",
        "enrichment_used": "runs % 40", "enrichment_allowance": "40", "actor_share_used": "runs % 21",
        "repository_share_used": "runs % 19", "consecutive_secondary_limits": "0",
    }
    return grouped.select(*[F.expr(exprs[f.name]).cast(f.dataType).alias(f.name) for f in S.CORE_BUDGET.fields])


def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search quota ledger after all requests."""
    grouped = batches(spark, sf_dir).agg(F.count("*").alias("b"), F.max("started_at").alias("t1"))
    exprs = {
        "id": "1", "resource": "'search'", "limit": "10", "remaining": "10 - b % 9",
        "reset_at": "t1 + INTERVAL 60 SECONDS", "observed_at": "t1", "request_ceiling": "10", "reserve": "2",
        "used": "b % 9", "actor_used": "b % 5", "repository_used": "b % 4", "blocked_until": "NULL",
        "last_request_at": "t1",
    }
    return grouped.select(*[F.expr(exprs[f.name]).cast(f.dataType).alias(f.name) for f in S.SEARCH_BUDGET.fields])


# --- lookups and their answers -----------------------------------------------------------


def members(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Leased lookups: customers as actors, parts as repositories, ten to a batch."""
    if kind == "actor":
        source = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("g"), F.col("c_name").alias("name"))
    else:
        source = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("g"), F.concat(
            F.lit("owner"), (F.col("p_partkey") % 50).cast("string"), F.lit("/part"), F.col("p_partkey").cast("string")).alias("name"))
    b = F.floor(F.col("g") / 10).cast("long")
    return source.select(
        F.format_string(f"{kind}-batch-%08d", b).alias("request_batch_id"), b.alias("b"), F.lit(kind).alias("entity_kind"),
        F.col("g").alias("github_id"), F.col("name").alias("identifier"), F.lit("batch_pending").alias("previous_stage"),
        F.when(F.col("g") % 9 == 0, "complete").otherwise("pending").alias("enrichment_status"),
        (F.col("g") % 3).cast("int").alias("enrichment_attempts"), (F.col("g") % 3).cast("int").alias("detail_attempts"),
        F.concat(F.lit("token-"), b.cast("string")).alias("lease_token"))


ITEM_SQL = {
    "actor": """concat('{"login":"', CASE WHEN g % 7 = 0 THEN upper(identifier) ELSE identifier END, '"',
        CASE WHEN g % 17 = 0 THEN concat(',"id":', g + 1000000000) WHEN g % 19 = 0 THEN '' ELSE concat(',"id":', g) END,
        CASE WHEN g % 11 = 0 THEN ',"type":" "' ELSE ',"type":"User"' END,
        CASE WHEN b % 2 = 0 THEN ',"score":1.0' ELSE '' END, '}')""",
    "repository": """concat('{"full_name":"', CASE WHEN g % 7 = 0 THEN concat(identifier, '-new') ELSE upper(identifier) END,
        '","id":', g, ',"owner":{"id":', CASE WHEN g % 11 = 0 THEN '"x"' ELSE cast(g % 50 AS STRING) END, ',"login":"owner', g % 50, '"}',
        ',"fork":', CASE WHEN g % 17 = 0 THEN 'null' WHEN g % 2 = 0 THEN 'true' ELSE 'false' END, ',"archived":false',
        ',"default_branch":"', CASE WHEN g % 19 = 0 THEN '' ELSE 'main' END, '"',
        ',"description":', CASE WHEN g % 23 = 0 THEN '7' WHEN g % 3 = 0 THEN 'null' ELSE '"a part"' END,
        ',"language":"SQL","created_at":"', CASE WHEN g % 29 = 0 THEN 'soon' ELSE '2011-01-26T19:01:12Z' END, '"',
        CASE WHEN b % 2 = 0 THEN ',"score":1.0' ELSE '' END, '}')""",
}


def search_answers(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One search answer per batch. Every thirteenth member is not returned, every fourth
    batch returns one item nobody asked for, and some batches fail as a whole."""
    asked = members(spark, sf_dir, kind).withColumn("g", F.col("github_id"))
    grouped = asked.groupBy("request_batch_id", "b").agg(F.sort_array(F.collect_list(F.when(
        F.col("g") % 13 != 0, F.struct("g", F.expr(ITEM_SQL[kind]).alias("item"))))).alias("rows"))
    extra = F.when(F.col("b") % 4 == 0, F.array(F.lit('{"id":77,"login":"nobody","full_name":"no/body"}'))).otherwise(
        F.array().cast("array<string>"))
    items = F.concat(extra, F.transform("rows", lambda r: r["item"]))
    body = (F.when(F.col("b") % 10 == 3, F.lit('{"message":"The listed users cannot be searched"}'))
            .when(F.col("b") % 10 == 5, F.lit('{"total_count":"3","incomplete_results":false,"items":[]}'))
            .when(F.col("b") % 10 == 7, F.lit("busy"))
            .otherwise(F.concat(F.lit('{"total_count":'), F.size(items).cast("string"), F.lit(',"incomplete_results":'),
                                F.when(F.col("b") % 6 == 0, "true").otherwise("false"), F.lit(',"items":['),
                                F.array_join(items, ","), F.lit("]}"))))
    status = F.when(F.col("b") % 10 == 3, 422).when(F.col("b") % 10 == 7, 503).when(F.col("b") % 10 == 9, 403).otherwise(200)
    remaining = F.when(F.col("b") % 10 == 9, "0").otherwise((F.col("b") % 8 + 1).cast("string"))
    return grouped.select(
        "request_batch_id", now().alias("received_at"), status.cast("int").alias("status"),
        F.create_map(F.lit("X-RateLimit-Remaining"), remaining, F.lit("X-RateLimit-Resource"), F.lit("search")).alias("headers"),
        body.alias("body"), F.lit(None).cast("string").alias("error_kind"),
        F.lit(None).cast("string").alias("error_message")).select(*ANSWER_LOG.names)


def detail_members(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The same entities, one lookup each."""
    return members(spark, sf_dir, kind).withColumn("request_batch_id", F.format_string(
        f"{kind}-detail-%08d", F.col("github_id")))


def detail_answers(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One detail answer per lookup: gone, refused, failing, empty, unreadable and good ones."""
    g = F.col("g")
    body = (F.when(g % 8 == 1, "").when(g % 8 == 2, "[1]").when(g % 8 == 3, "{oops").otherwise(F.expr(ITEM_SQL[kind])))
    status = F.when(g % 8 == 4, 404).when(g % 8 == 5, 500).when(g % 16 == 6, 429).when(g % 16 == 7, 451).otherwise(200)
    remaining = F.when(g % 16 == 6, "0").otherwise("5")
    return detail_members(spark, sf_dir, kind).withColumn("g", F.col("github_id")).select(
        "request_batch_id", now().alias("received_at"), status.cast("int").alias("status"),
        F.create_map(F.lit("x-ratelimit-remaining"), remaining).alias("headers"), body.alias("body"),
        F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("string").alias("error_message"))


def leased_entities(spark: SparkSession, sf_dir: str, kind: str, detail: bool = False) -> DataFrame:
    """Entity rows under those leases; every 37th has since been leased to someone else."""
    asked = (detail_members if detail else members)(spark, sf_dir, kind)
    exprs = {
        "seq": "github_id", "github_id": "github_id", "enrichment_status": "enrichment_status",
        "enrichment_stage": "'detail_in_flight'" if detail else "'batch_in_flight'",
        "enrichment_attempts": "enrichment_attempts", "detail_attempts": "detail_attempts",
        "lease_token": "CASE WHEN github_id % 37 = 0 THEN 'other' ELSE lease_token END",
        "leased_until": f"TIMESTAMP'{NOW}' + INTERVAL 600 SECONDS", "current_batch_id": "request_batch_id",
        "created_at": f"TIMESTAMP'{NOW}' - INTERVAL 1 DAY", "updated_at": f"TIMESTAMP'{NOW}' - INTERVAL 1 DAY",
        "login" if kind == "actor" else "full_name": "identifier",
    }
    return asked.select(*[F.expr(exprs.get(f.name, "NULL")).cast(f.dataType).alias(f.name)
                          for f in S.ENTITY_TABLES[kind].fields])


def open_batches(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The batch rows those leases belong to, still in flight."""
    grouped = members(spark, sf_dir, kind).groupBy("request_batch_id").agg(
        F.sort_array(F.collect_list("github_id")).alias("ids"), F.count("*").alias("k"))
    exprs = {
        "correlation_id": "request_batch_id", "request_kind": "'search'", "entity_kind": f"'{kind}'",
        "status": "'in_flight'", "requested_github_ids": "ids", "requested_count": "k", "returned_count": "0",
        "valid_count": "0", "missing_count": "0", "invalid_count": "0", "started_at": f"TIMESTAMP'{NOW}'",
        "created_at": f"TIMESTAMP'{NOW}'", "updated_at": f"TIMESTAMP'{NOW}'",
    }
    return grouped.select(*[F.expr(exprs.get(f.name, "NULL")).cast(f.dataType).alias(f.name)
                            for f in S.BATCHES.fields])
