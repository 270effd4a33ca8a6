import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedledger.functions.cursors import decode_cursor, encode_cursor
from feedledger.functions.http import header, next_link, rate_limit_fields, request_key, url_violations
from feedledger.functions.scalars import parse_iso8601
from feedledger.operators.selection import split_allowance
from feedledger.plans.listings import InvalidParameter, event_page, page_request
from feedledger.workload import feed


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_iso8601(spark):
    cases = {
        "2026-07-29T11:58:12Z": "2026-07-29 11:58:12", "2026-07-29": None, "yesterday": None,
        "2026-07-29T11:58:12.123456789+02:30": "2026-07-29 09:28:12.123456", "2026-02-30T00:00:00Z": "2026-03-02 00:00:00",
        "2026-07-29T24:00:00Z": "2026-07-30 00:00:00", "2026-07-29T24:00:01Z": None, "2026-07-29T11:58:60Z": "2026-07-29 11:59:00",
        "2026-13-01T00:00:00Z": None, "2026-07-32T00:00:00Z": None, "2026-07-29T11:58:12": "2026-07-29 11:58:12",
        "2026-07-29t11:58:12-05": "2026-07-29 16:58:12", "2026-07-29T11:58:12Z x": None, None: None,
    }
    got = values(spark, list(cases), parse_iso8601)
    assert [None if v is None else str(v) for v in got] == list(cases.values())


def test_links(spark):
    cases = {
        '<https://x/2>; rel="next", <https://x/9>; rel="last"': "https://x/2",
        '<https://x/9>; rel="last", <https://x/2>; foo="a,b"; REL="prev NEXT"': "https://x/2",
        "<https://x/2>; rel=next": "https://x/2", '<https://x/2>; rel="nextly"': None,
        '< >; rel="next", <https://x/3>; rel="next"': "https://x/3", "": None, None: None, "garbage": None,
    }
    assert values(spark, list(cases), next_link) == list(cases.values())


def test_request_keys(spark):
    cases = {"https://x/e?b=2&a=1": "/e?a=1&b=2", "https://x/e": "/e", "https://x/e?a=%2Fq+r": "/e?a=%2Fq+r",
             "https://y/e?a=1&b=2": "/e?a=1&b=2", "https://x/e?": "/e"}
    assert values(spark, list(cases), request_key) == list(cases.values())


def test_url_violations(spark):
    cases = {
        "https://api.github.com/users/x": [], "https://API.github.com:443/": [], "": ["blank"], "  ": ["blank"],
        "https://exa mple": ["unparsable"], "https://api.github.com:x/": ["unparsable"], "/users": ["not_absolute", "host_missing"],
        "http://api.github.com/": ["scheme_not_allowed"], "https://u@api.github.com/": ["userinfo_present"],
        "https://127.0.0.1/": ["ip_literal_host"], "https://[::1]/": ["ip_literal_host"],
        "https://api.github.com:8443/": ["non_default_port"], "https://evil.com/": ["host_not_allowed"],
        "https:///x": ["host_missing"], "ftp://u:p@1.2.3.4/": ["scheme_not_allowed", "userinfo_present", "ip_literal_host"],
    }
    assert values(spark, list(cases), url_violations) == list(cases.values())


def test_quota_headers(spark):
    at = dt.datetime(2026, 7, 29, 12, 0)
    rows = [({"X-RateLimit-Limit": " 60 ", "x-ratelimit-remaining": "x", "Retry-After": "Wed, 29 Jul 2026 12:00:30 GMT",
              "ETAG": ' W/"1" ', "X-RateLimit-Reset": "1785326400"}, at), ({"retry-after": "1_0"}, at), ({}, at), (None, at)]
    df = spark.createDataFrame(rows, "h map<string,string>, at timestamp").select(
        rate_limit_fields(F.col("h"), F.col("at")).alias("q"), header(F.col("h"), "etag").alias("e"))
    q = [r["q"] for r in df.collect()]
    assert (q[0]["limit"], q[0]["remaining"], q[0]["retry_after_seconds"], q[0]["etag"]) == (60, None, 30, 'W/"1"')
    assert str(q[0]["reset_at"]) == "2026-07-29 12:00:00"
    assert q[1]["retry_after_seconds"] == 10 and set(q[2].asDict().values()) == {None} == set(q[3].asDict().values())


def test_cursors(spark):
    bad = ["", "%%%", "abc", "MjAyNi0wNy0yOXwx", None, "fDE", "MjAyNi0wNy0yOVQxMTo1ODoxMlp8LTE"]
    assert values(spark, bad, decode_cursor) == [None] * len(bad)
    row = spark.range(1).select(decode_cursor(encode_cursor(F.lit("2026-07-29 11:58:12.5").cast("timestamp"), F.lit(2**63 - 1))).alias("c"))
    assert row.first()["c"]["seq"] == 2**63 - 1


def test_page_parameters():
    assert page_request().limit == 25 and page_request(limit=" ").limit == 25 and page_request(limit="100").limit == 100
    for bad in ({"limit": 0}, {"limit": "101"}, {"limit": "x"}, {"actor_id": "0"}, {"repository_id": str(2**63)}, {"page": 1}):
        with pytest.raises(InvalidParameter):
            page_request(**bad)


def test_paging_visits_every_event_once(spark, sf_dir):
    events = feed.push_events(spark, sf_dir).where("github_repository_id < 1050").cache()
    total, cursor, seen = events.count(), None, []
    while True:
        rows = event_page(events, page_request(limit=60, cursor=cursor)).collect()
        seen += [(r["occurred_at"], r["seq"]) for r in rows]
        cursor = rows[0]["next_cursor"]
        if cursor is None:
            break
    assert len(seen) == total == len(set(seen)) and seen == sorted(seen, reverse=True)
    with pytest.raises(InvalidParameter):
        event_page(events, page_request(cursor="nonsense"))
    events.unpersist()


def test_exact_share():
    assert split_allowance(100, "0.29") == (29, 71) and split_allowance(40, "0.50") == (20, 20)
