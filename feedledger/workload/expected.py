"""SQL of the oracles: what the derived feeds must lead to, from the plain columns."""

from __future__ import annotations

from feedledger.workload.feed import NOW, STATE_SQL, instants_sql

NOW_SQL = f"TIMESTAMP '{NOW}'"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def micros(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ')"


# Every delivery with its place, its arrival and what classification must find.
DELIVERIES = """
ev AS (SELECT event_id AS n, ts, user_id, event_type FROM events),
placed AS (
  SELECT n, ts, user_id, event_type, n // 1000 AS run, CAST(1 + (n // 100) % 10 AS INTEGER) AS page_no FROM ev
  UNION ALL
  SELECT n, ts, user_id, event_type, n // 1000 AS run, 11 AS page_no FROM ev WHERE n % 10 = 0),
arrived AS (
  SELECT *, 'run-' || lpad(CAST(run AS VARCHAR), 8, '0') AS run_id,
    CAST(row_number() OVER (PARTITION BY run, page_no ORDER BY n) - 1 AS INTEGER) AS pos,
    max(ts) OVER (PARTITION BY run, page_no)
      + CASE WHEN page_no = 11 THEN INTERVAL 1 DAY ELSE INTERVAL 60 SECOND END AS received_at,
    CASE WHEN n % 41 <> 0 THEN CAST(58000000000 + n AS VARCHAR) END AS id,
    CASE WHEN n % 43 <> 0 THEN CASE WHEN event_type = 'view' THEN 'WatchEvent' ELSE 'PushEvent' END END AS type,
    user_id + 1 AS actor_id, 'user' || user_id AS login,
    CASE WHEN n % 2 = 0 THEN 'user' || user_id END AS display_login,
    'https://avatars.example.org/' || user_id AS avatar_url,
    1000 + n % 400 AS repo_id, 'org' || n % 7 || '/repo' || n % 400 AS full_name,
    'repo' || n % 400 AS repo_name, 'org' || n % 7 AS owner_login,
    date_trunc('second', ts) AS occurred_at
  FROM placed),
coded AS (
  SELECT *, CASE
    WHEN type IS NULL THEN 'missing_event_type'
    WHEN type <> 'PushEvent' THEN NULL
    WHEN id IS NULL THEN 'missing_event_id'
    WHEN n % 47 = 0 THEN 'invalid_actor_reference'
    WHEN n % 61 = 0 THEN 'invalid_occurred_at'
    WHEN n % 53 = 0 OR n % 29 = 0 THEN 'missing_required_field'
    WHEN n % 37 = 0 THEN 'invalid_field_format'
    WHEN n % 31 = 0 THEN 'repository_id_mismatch'
    WHEN n % 593 = 0 THEN 'identifier_out_of_range' END AS code
  FROM arrived),
d AS (
  SELECT *, CASE WHEN code IS NOT NULL THEN 'quarantined' WHEN type = 'WatchEvent' THEN 'ignored'
                 ELSE 'push_event' END AS outcome
  FROM coded)"""

# Canonical text of an envelope: keys in byte order, no spaces.
ACTOR_TEXT = """'{"avatar_url":"' || avatar_url || '",' || CASE WHEN n % 2 = 0 THEN '"display_login":"user' || user_id || '",' ELSE '' END
  || '"id":' || actor_id || ',"login":"' || CASE WHEN n % 47 = 0 THEN '' ELSE login END || '"}'"""
REPO_TEXT = """'{"id":' || repo_id || ',"name":"' || full_name || '"}'"""
CANONICAL = f"""'{{"actor":' || {ACTOR_TEXT} || ',"created_at":"'
  || CASE WHEN n % 61 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END || '",'
  || CASE WHEN n % 41 = 0 THEN '' ELSE '"id":"' || (58000000000 + n) || '",' END
  || '"payload":{{"before":"' || sha256(CAST(n AS VARCHAR)) || '",'
  || CASE WHEN n % 29 = 0 THEN '' WHEN n % 37 = 0 THEN '"head":"zz",'
          ELSE '"head":"' || md5(CAST(n AS VARCHAR)) || substr(md5(CAST(n AS VARCHAR)), 1, 8) || '",' END
  || '"push_id":' || CASE WHEN n % 593 = 0 THEN '9223372036854775808' ELSE CAST(n AS VARCHAR) END
  || ',"ref":' || CASE WHEN n % 53 = 0 THEN 'null' ELSE '"refs/heads/' || event_type || '"' END
  || ',"repository_id":' || (repo_id + CASE WHEN n % 31 = 0 THEN 1 ELSE 0 END) || '}},"public":true,"repo":' || {REPO_TEXT}
  || CASE WHEN n % 43 = 0 THEN '' ELSE ',"type":"' || type || '"' END || '}}'"""

# Messages of the broken rules, in check order.
MESSAGE = """CASE WHEN type IS NULL THEN 'type is absent' ELSE concat_ws('; ',
  CASE WHEN id IS NULL THEN 'id is absent' END,
  CASE WHEN n % 47 = 0 THEN 'actor.login is empty' END,
  CASE WHEN n % 61 = 0 THEN 'created_at is "' || strftime(ts, '%Y-%m-%d') || '"' END,
  CASE WHEN n % 53 = 0 AND n % 29 = 0 THEN 'payload is missing ref, head'
       WHEN n % 53 = 0 THEN 'payload is missing ref' WHEN n % 29 = 0 THEN 'payload is missing head' END,
  CASE WHEN n % 593 = 0 THEN 'payload.push_id 9223372036854775808 exceeds a 64-bit identifier' END,
  CASE WHEN n % 37 = 0 AND n % 29 <> 0 THEN 'payload.head is "zz", not 40 or 64 hexadecimal characters' END,
  CASE WHEN n % 31 = 0 THEN 'payload.repository_id ' || (repo_id + 1) || ' does not match repo.id ' || repo_id END) END"""

CREATED = """
created AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, run_id, page_no, pos) AS delivery
  FROM d WHERE outcome = 'push_event') WHERE delivery = 1)"""


def deliveries(select: str, *more: str) -> str:
    return f"WITH {DELIVERIES}{''.join(',' + cte for cte in more)}\n{select}"


# --- derived state -----------------------------------------------------------------------

_DUCK_HOURS = f"({NOW_SQL} + to_hours(CAST({{0}} AS INTEGER)))"
_STATE = {**STATE_SQL, **instants_sql(_DUCK_HOURS)}


def entity_cte(kind: str, name: str | None = None) -> str:
    key = "user_id + 1" if kind == "actor" else "1000 + event_id % 400"
    ident = "'user' || (g - 1)" if kind == "actor" else "'org' || g % 7 || '/repo' || (g - 1000)"
    columns = ",\n  ".join(f"{sql} AS {column}" for column, sql in _STATE.items())
    return f"""
{name or kind} AS (SELECT '{kind}' AS entity_kind, g, g AS github_id, g AS seq, {ident} AS identifier,
  'https://api.example.org/{kind}/' || g AS api_url, t0 AS created_at, t1 AS updated_at, t0 AS first_seen_at, t1 AS last_seen_at,
  t1 AS latest_event_at, CAST(g % 4 AS INTEGER) AS enrichment_attempts, CAST(g % 3 AS INTEGER) AS detail_attempts,
  CASE WHEN g % 5 = 2 THEN 'server_error' END AS last_error,
  CASE WHEN g % 5 = 2 AND g % 4 = 0 OR g % 5 IN (0, 4) AND g % 3 = 2 THEN t1 END AS detail_pending_at,
  {columns}
  FROM (SELECT {key} AS g, min(ts) AS t0, max(ts) AS t1 FROM events WHERE event_type <> 'view' GROUP BY 1))"""


DUE = f"((leased_until IS NULL OR leased_until <= {NOW_SQL}) AND (next_retry_at IS NULL OR next_retry_at <= {NOW_SQL}))"
BACKLOG = f"""({DUE} AND enrichment_status IN ('pending', 'retryable_failure')
  AND enrichment_stage IN ('batch_pending', 'retry_scheduled', 'batch_in_flight'))"""
REFRESH = f"""({DUE} AND enrichment_status = 'complete' AND enrichment_stage IN ('contract_complete', 'batch_in_flight')
  AND fetched_at <= {NOW_SQL} - INTERVAL 1 DAY AND last_seen_at >= {NOW_SQL} - INTERVAL 7 DAY)"""
DETAIL = f"({DUE} AND enrichment_stage IN ('detail_pending', 'detail_in_flight') AND detail_pending_at IS NOT NULL)"


def state(select: str, *ctes: str) -> str:
    return f"WITH {','.join([entity_cte('actor'), entity_cte('repository'), *ctes])}\n{select}"


BATCHES = """
batches AS (SELECT b, 'batch-' || b AS correlation_id,
  CASE WHEN b % 3 = 0 THEN 'detail' ELSE 'search' END AS request_kind,
  CASE WHEN b % 3 = 0 OR b % 2 = 0 THEN 'actor' ELSE 'repository' END AS entity_kind,
  CASE b % 6 WHEN 0 THEN 'in_flight' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed'
             WHEN 4 THEN 'deferred' ELSE 'stale_lease' END AS status,
  asked AS requested_count, got AS returned_count, good AS valid_count, asked - got AS missing_count,
  got - good AS invalid_count, CASE WHEN b % 8 = 0 THEN true WHEN b % 8 = 1 THEN false END AS incomplete_results,
  t0 AS started_at, CASE WHEN b % 6 IN (1, 2) THEN CASE WHEN b % 3 = 0 THEN 'core' ELSE 'search' END END AS resource,
  CASE WHEN b % 3 = 0 THEN 60 ELSE 10 END AS q_limit,
  CASE WHEN b % 3 = 0 THEN 60 - b % 50 ELSE 10 - b % 10 END AS q_remaining,
  CASE WHEN b % 3 = 0 THEN b % 50 ELSE b % 10 END AS q_used, date_trunc('day', t0) + INTERVAL 1 DAY AS q_reset
  FROM (SELECT event_id // 10 AS b, count(*) AS asked, count(*) FILTER (WHERE value > 5) AS got,
               count(*) FILTER (WHERE value > 20) AS good, min(ts) AS t0 FROM events GROUP BY 1))"""

RUNS = """
runs AS (SELECT b, 'run-' || lpad(CAST(b AS VARCHAR), 8, '0') AS run_id, b % 5 AS source_id,
  CASE b % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'completed' WHEN 2 THEN 'not_modified' WHEN 3 THEN 'failed'
             WHEN 4 THEN 'deferred' ELSE 'running' END AS status,
  t0 AS started_at, CASE WHEN b % 6 <> 5 THEN date_trunc('hour', t1) END AS completed_at,
  seen, pushed, made
  FROM (SELECT event_id // 100 AS b, count(*) AS seen, count(*) FILTER (WHERE event_type <> 'view') AS pushed,
               count(*) FILTER (WHERE event_type <> 'view' AND value > 10) AS made, min(ts) AS t0, max(ts) AS t1
        FROM events GROUP BY 1))"""

SOURCES = f"""
sources AS (SELECT s AS id, CASE WHEN s = 3 THEN 'fixture_events' ELSE 'public_events' END AS source_type,
  s <> 4 AS enabled, CASE WHEN s = 2 THEN 'failed' ELSE 'idle' END AS status, f AS consecutive_failures,
  t1 + INTERVAL 300 SECOND AS cadence_due_at, CASE WHEN s % 2 = 0 THEN t1 + INTERVAL 600 SECOND END AS poll_floor_until,
  CASE WHEN s = 1 THEN t1 + INTERVAL 3 DAY END AS retry_not_before_at,
  CASE WHEN s <> 0 THEN t1 + INTERVAL 300 SECOND END AS next_poll_at
  FROM (SELECT source_id AS s, max(started_at) AS t1, count(*) FILTER (WHERE status = 'failed') AS f FROM runs GROUP BY 1))"""

BUDGET = """
budget AS (SELECT n AS runs_n, date_trunc('hour', t1) + INTERVAL 1 HOUR AS reset_at, 60 - n % 50 AS remaining,
  12 + n % 3 AS poll_used, 12 AS poll_allowance FROM (SELECT count(*) AS n, max(started_at) AS t1 FROM runs))"""

PUSHES = """
pushes AS (SELECT event_id + 1 AS seq, CAST(58000000000 + event_id AS VARCHAR) AS github_event_id, event_id AS n,
  user_id + 1 AS actor_id, 1000 + event_id % 400 AS repo_id, date_trunc('hour', ts) AS occurred_at,
  ts + INTERVAL 60 SECOND AS created_at, 'refs/heads/' || event_type AS ref, event_type
  FROM events WHERE event_type <> 'view')"""


# --- lookups -----------------------------------------------------------------------------

_NAMES = {"actor": ("CAST(c_custkey AS BIGINT)", "c_name", "customer"),
          "repository": ("CAST(p_partkey AS BIGINT)", "'owner' || p_partkey % 50 || '/part' || p_partkey", "part")}


def members_cte(kind: str) -> str:
    key, name, source = _NAMES[kind]
    return f"""
m AS (SELECT *, '{kind}-batch-' || lpad(CAST(b AS VARCHAR), 8, '0') AS request_batch_id,
  '{kind}-detail-' || lpad(CAST(g AS VARCHAR), 8, '0') AS detail_id,
  CASE b % 10 WHEN 3 THEN 'rejected' WHEN 5 THEN 'malformed' WHEN 7 THEN 'failed' WHEN 9 THEN 'deferred' ELSE 'ok' END AS verdict,
  CASE WHEN b % 4 = 0 THEN 1 ELSE 0 END AS extra, g % 13 <> 0 AS returned,
  CASE WHEN g % 13 <> 0 THEN CASE WHEN b % 4 = 0 THEN 1 ELSE 0 END
    + row_number() OVER (PARTITION BY b, g % 13 <> 0 ORDER BY g) - 1 END AS pos,
  g % 37 <> 0 AS held, CAST(g % 3 AS INTEGER) AS tries,
  CASE WHEN g % 9 = 0 THEN 'complete' ELSE 'pending' END AS old_status
  FROM (SELECT {key} AS g, {key} // 10 AS b, {name} AS identifier FROM {source}))"""


ITEM_OUTCOME = {
    "actor": """CASE WHEN NOT returned THEN NULL WHEN g % 17 = 0 OR g % 19 = 0 THEN 'identity_mismatch'
                     WHEN g % 11 = 0 THEN 'invalid_contract_field' ELSE 'applied' END""",
    "repository": """CASE WHEN NOT returned THEN NULL WHEN g % 7 = 0 THEN 'renamed_repository'
                     WHEN g % 11 = 0 OR g % 17 = 0 OR g % 19 = 0 OR g % 23 = 0 OR g % 29 = 0
                     THEN 'invalid_contract_field' ELSE 'applied' END""",
}


def lookups(kind: str, select: str, *ctes: str) -> str:
    judged = f"""
j AS (SELECT *, {ITEM_OUTCOME[kind]} AS outcome FROM m)"""
    return f"WITH {','.join([members_cte(kind), judged, *ctes])}\n{select}"


# Detail lookups: what each answer is, and what it leads to.
DETAILS = """
x AS (SELECT *, CASE g % 8 WHEN 4 THEN 'not_found' WHEN 5 THEN 'server_error' ELSE
    CASE g % 16 WHEN 6 THEN 'rate_limited' WHEN 7 THEN 'client_error' ELSE 'ok' END END AS klass,
  CASE WHEN g % 8 IN (1, 3) THEN 'unparsable_document' WHEN g % 8 = 2 THEN 'not_an_object'
       WHEN g % 17 = 0 THEN 'identity_mismatch' WHEN g % 19 = 0 THEN 'missing_identity'
       WHEN g % 11 = 0 THEN 'invalid_contract_field' ELSE 'applied' END AS found,
  CASE WHEN g % 8 = 1 THEN 'response body was empty' WHEN g % 8 = 2 THEN 'expected a JSON object, got Array'
       WHEN g % 8 = 3 THEN 'response body is not valid JSON'
       WHEN g % 17 = 0 THEN 'document identifies ' || (g + 1000000000) || ', expected ' || g
       WHEN g % 19 = 0 THEN 'document carries no integer id'
       WHEN g % 11 = 0 THEN 'type is not a non-empty string' END AS said
  FROM m),
y AS (SELECT *, CASE WHEN klass = 'rate_limited' THEN 'deferred' WHEN klass = 'ok' AND found = 'applied' THEN 'completed'
    WHEN klass IN ('not_found', 'client_error') THEN 'terminal' WHEN tries + 1 >= 3 THEN 'terminal' ELSE 'retry' END AS dv,
  CASE WHEN klass = 'ok' THEN said WHEN klass = 'not_found' THEN 'entity_gone_404' ELSE klass END AS why
  FROM x)"""
