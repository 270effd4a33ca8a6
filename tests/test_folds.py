import datetime as dt
import random

from feedledger.operators.folds import identity_fold
from feedledger.schemas import ACTORS

START = dt.datetime(2026, 7, 1, tzinfo=dt.timezone.utc)
FIELDS = ("login", "display_login", "api_url", "avatar_url")


def plain_fold(row, observations):
    """The rule, one observation at a time."""
    for at, values in observations:
        if row is None:
            row = {**values, "created_at": at, "updated_at": at}
            continue
        if at >= row["updated_at"]:
            for field in FIELDS:
                if values[field] is not None:
                    row[field] = values[field]
        row["updated_at"] = max(row["updated_at"], at)
    return row


def test_random_sequences_against_a_plain_fold(spark):
    """1,000 entities, three batches each, with ties, gaps and batches that arrive late."""
    rng = random.Random(7)
    expected, old = {}, None
    schema = ("github_id long, login string, display_login string, api_url string, avatar_url string, "
              "received_at timestamp, run_id string, page_no int, pos int")
    for batch in range(3):
        rows = []
        for entity in range(1000):
            base = rng.randint(0, 6)
            seen = []
            for pos in range(rng.randint(0, 6)):
                at = START + dt.timedelta(minutes=base + rng.randint(0, 3))
                values = {f: (rng.choice("abc") if f == "login" or rng.random() < 0.5 else None) for f in FIELDS}
                key = (at, f"run-{rng.randint(0, 1)}", rng.randint(1, 2), entity * 10 + pos)
                seen.append((key, values))
                rows.append((entity, *[values[f] for f in FIELDS], *key))
            ordered = [(key[0], values) for key, values in sorted(seen, key=lambda s: s[0])]
            if ordered:
                expected[entity] = plain_fold(expected.get(entity), ordered)
        rng.shuffle(rows)
        folded = identity_fold("actor", spark.createDataFrame(rows, schema), old)
        got = {r["github_id"]: r.asDict() for r in folded.collect()}
        assert len(got) == len(expected)
        for entity, row in expected.items():
            assert {f: got[entity][f] for f in FIELDS} == {f: row[f] for f in FIELDS}, entity
            assert got[entity]["updated_at"] == row["updated_at"].replace(tzinfo=None)
            assert got[entity]["created_at"] == row["created_at"].replace(tzinfo=None)
        rows_out = [tuple(got[e].get(f.name) for f in ACTORS.fields) for e in got]
        old = spark.createDataFrame(rows_out, ACTORS)
