"""Envelopes and pages for the tests."""

import copy
import datetime as dt
import json

NOON = dt.datetime(2026, 7, 29, 12, 1, tzinfo=dt.timezone.utc)
SHA = "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e7f8a9b0"


def push(n=1, **changes):
    """A well-formed push; ``changes`` replace top-level fields, dicts merge one level deep."""
    envelope = {
        "id": str(58000000000 + n), "type": "PushEvent",
        "actor": {"id": 583231, "login": "octo", "display_login": "octo", "url": "https://x/users/octo"},
        "repo": {"id": 1296269, "name": "octo/hello", "url": "https://x/repos/octo/hello"},
        "payload": {"repository_id": 1296269, "push_id": 27500000000 + n, "ref": "refs/heads/main",
                    "head": SHA, "before": SHA[::-1]},
        "public": True, "created_at": "2026-07-29T11:58:12Z",
    }
    for key, value in changes.items():
        if isinstance(value, dict) and isinstance(envelope.get(key), dict):
            envelope[key] = {**envelope[key], **value}
        else:
            envelope[key] = value
    return envelope


def without(envelope, key, inner=None):
    cut = copy.deepcopy(envelope)
    del (cut[key] if inner else cut)[inner or key]
    return cut


def second(n):
    return push(n, actor={"id": 1024025, "login": "mona", "display_login": "mona"},
                repo={"id": 1300192, "name": "mona/spoon"}, payload={"repository_id": 1300192})


PAGE_1 = [
    push(1), second(2),
    push(3, repo={"id": 1300192, "name": "mona/spoon"}, payload={"repository_id": 1300192}),
    push(4, type="WatchEvent"), without(push(5), "payload", "head"),
    push(6, payload={"head": "not-a-valid-object-name"}), without(push(7), "type"),
    push(8, actor={"id": 7700421, "login": "ghost"}, repo={"id": 1490033, "name": "deleted-org/gone"},
         payload={"repository_id": 1490033}),
]
PAGE_2 = [push(1), push(9), second(10)]


def log(spark, pages):
    """Pages as (run_id, page_no, minutes after noon, body or envelopes, link)."""
    from feedledger.schemas import FETCH_LOG

    rows = []
    for run_id, page_no, minutes, body, *link in pages:
        text = body if isinstance(body, str) else json.dumps(body)
        headers = {"Link": link[0]} if link else {}
        rows.append((run_id, 1, page_no, f"https://x/events?page={page_no}", NOON + dt.timedelta(minutes=minutes),
                     200, headers, text))
    return spark.createDataFrame(rows, FETCH_LOG)


def nxt(page):
    return f'<https://x/events?page={page}>; rel="next"'
