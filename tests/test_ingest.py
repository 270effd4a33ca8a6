import json
import re

import pytest
from pyspark.sql import functions as F

from corpus import PAGE_1, PAGE_2, log, nxt, push
from feedledger.operators.ingest import ingest_batch
from feedledger.plans.reports import entity_state_fingerprint
from feedledger.operators.known_ids import remember, stored_among
from feedledger.sources.commits import Transaction, expire
from feedledger.sources.tables import check_constraints, read_log, read_snapshot


def counters(run):
    return tuple(run[c] for c in ("pages_fetched", "events_received", "push_events_seen", "events_created",
                                  "duplicates_skipped", "events_quarantined", "events_failed"))


def digest(spark, root):
    return entity_state_fingerprint(*[read_snapshot(spark, root, t) for t in ("actors", "repositories")]).first()


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Page 1, page 1 again as a later run, then both pages, the last batch taken twice."""
    folder = str(tmp_path_factory.mktemp("tables"))
    first = ingest_batch(log(spark, [("a", 1, 0, PAGE_1)]), folder, 0).first()
    assert counters(first) == (1, 8, 6, 4, 0, 3, 0) and first["status"] == "completed"
    before = digest(spark, folder)
    again = ingest_batch(log(spark, [("b", 1, 60, PAGE_1)]), folder, 1).first()
    assert counters(again) == (1, 8, 6, 0, 4, 3, 0)
    assert digest(spark, folder) == before
    for _ in range(2):
        third = ingest_batch(log(spark, [("c", 1, 120, PAGE_1, nxt(2)), ("c", 2, 121, PAGE_2)]), folder, 2,
                             max_pages=3).first()
        assert counters(third) == (2, 11, 9, 2, 5, 3, 0)
    return folder


def test_events_keep_their_first_delivery(spark, root):
    events = read_log(spark, root, "push_events").orderBy("seq").collect()
    assert [e["github_event_id"][-2:] for e in events] == ["01", "02", "03", "08", "09", "10"]
    assert [e["seq"] for e in events] == [1, 2, 3, 4, 5, 6]


def test_entities(spark, root):
    actors = {r["login"]: r for r in read_snapshot(spark, root, "actors").collect()}
    repositories = {r["full_name"]: r for r in read_snapshot(spark, root, "repositories").collect()}
    assert {n: r["seq"] for n, r in actors.items()} == {"octo": 1, "mona": 2, "ghost": 3}
    assert set(repositories) == {"octo/hello", "mona/spoon", "deleted-org/gone"}
    ghost, octo = actors["ghost"], actors["octo"]
    # Only a created event moves activity; any accepted delivery moves updated_at.
    assert str(ghost["last_seen_at"]) == "2026-07-29 12:01:00" and str(ghost["updated_at"]) == "2026-07-29 14:01:00"
    assert str(octo["last_seen_at"]) == "2026-07-29 14:02:00" and str(octo["created_at"]) == "2026-07-29 12:01:00"
    assert (octo["enrichment_status"], octo["enrichment_stage"]) == ("pending", "batch_pending")
    assert str(octo["batch_pending_at"]) == "2026-07-29 12:01:00"


def test_quarantine_counts(spark, root):
    rows = read_snapshot(spark, root, "quarantined_events").collect()
    assert len(rows) == 3 and {r["occurrence_count"] for r in rows} == {3}
    assert {str(r["first_received_at"]) for r in rows} == {"2026-07-29 12:01:00"}
    assert {str(r["last_received_at"]) for r in rows} == {"2026-07-29 14:01:00"}


def test_evidence_and_rules(spark, root):
    observations = read_log(spark, root, "observations")
    assert observations.count() == 12
    events = read_log(spark, root, "push_events")
    related = {"actors": read_snapshot(spark, root, "actors"),
               "repositories": read_snapshot(spark, root, "repositories"), "push_events": events}
    for name, df in {**related, "observations": observations,
                     "quarantined_events": read_snapshot(spark, root, "quarantined_events")}.items():
        assert check_constraints(df, name, related).collect() == []


def test_a_push_without_evidence_fails_until_its_id_is_taken(spark, tmp_path):
    broken = json.dumps(push(1)).replace('"id": 583231', '"id": 583231, "w": 1e400')
    other = json.dumps(push(2, actor={"id": 5, "login": "lost"})).replace('"id": 5,', '"id": 5, "w": 1e400,')
    body = "[" + ",".join([broken, json.dumps(push(1)), broken, other]) + "]"
    run = ingest_batch(log(spark, [("a", 1, 0, body)]), str(tmp_path), 0).first()
    assert counters(run) == (1, 4, 4, 1, 1, 0, 2)
    assert [r["login"] for r in read_snapshot(spark, str(tmp_path), "actors").collect()] == ["octo"]
    later = ingest_batch(log(spark, [("b", 1, 5, f"[{broken}]")]), str(tmp_path), 1).first()
    assert counters(later) == (1, 1, 1, 0, 1, 0, 0)


def test_late_batch_does_not_move_identity_back(spark, tmp_path):
    root = str(tmp_path)
    ingest_batch(log(spark, [("a", 1, 60, [push(1, actor={"login": "new"})])]), root, 0)
    ingest_batch(log(spark, [("b", 1, 0, [push(2, actor={"login": "old", "avatar_url": "u"})])]), root, 1)
    actor = read_snapshot(spark, root, "actors").first()
    assert (actor["login"], actor["avatar_url"]) == ("new", None)
    assert str(actor["first_seen_at"]) == "2026-07-29 12:01:00" and str(actor["last_seen_at"]) == "2026-07-29 13:01:00"


def test_failed_and_deferred_runs(spark, tmp_path):
    pages = log(spark, [("bad", 1, 0, '{"message":"x"}'), ("late", 1, 1, "[]"), ("gone", 1, 2, "[]")])
    status = F.when(F.col("run_id") == "late", 429).when(F.col("run_id") == "gone", 404).otherwise(200)
    runs = ingest_batch(pages.withColumn("status", status), str(tmp_path), 0).collect()
    assert {r["run_id"]: r["status"] for r in runs} == {"bad": "failed", "late": "deferred", "gone": "failed"}


def test_logs_open_only_the_days_asked_for(spark, root):
    whole = read_log(spark, root, "push_events")
    assert read_log(spark, root, "push_events", since=F.lit("2026-07-29")).count() == whole.count() == 6
    later = read_log(spark, root, "push_events", since=F.lit("2026-07-30"))
    assert later.count() == 0 and "PartitionFilters" in later._jdf.queryExecution().toString()


def test_expired_manifests_leave_the_live_rows(spark, root):
    before = read_snapshot(spark, root, "actors").count()
    removed = expire(spark, root)
    assert removed and not [r for r in removed if r.startswith("push_events")]
    assert expire(spark, root, keep=0) == []
    assert read_snapshot(spark, root, "actors").count() == before and read_log(spark, root, "push_events").count() == 6


CUT = [("a", 1, 0, [push(1), push(2)], nxt(2)), ("b", 1, 1, [push(3)], nxt(2)), ("a", 2, 2, [push(1), push(4)], nxt(3)),
       ("b", 2, 3, [push(5)], nxt(1)), ("a", 3, 4, "[]", nxt(4)), ("b", 3, 5, [push(6)], nxt(4)), ("a", 4, 6, [push(7)])]


def tables_of(spark, root):
    runs = sorted(map(tuple, read_snapshot(spark, root, "ingestion_runs").collect()))
    events = sorted((e["github_event_id"], e["seq"]) for e in read_log(spark, root, "push_events").collect())
    return runs, events, digest(spark, root)


@pytest.mark.parametrize("cuts", [(2, 5)])
def test_runs_split_over_batches_end_as_in_one(spark, tmp_path, cuts):
    """An empty page, a link loop and pages past both."""
    whole = str(tmp_path / "whole")
    ingest_batch(log(spark, CUT), whole, 0)
    split = str(tmp_path / "split")
    for batch, (first, last) in enumerate(zip((0, *cuts), (*cuts, len(CUT)))):
        ingest_batch(log(spark, CUT[first:last]), split, batch)
    got, want = tables_of(spark, split), tables_of(spark, whole)
    assert got == want
    assert {r[0]: r[5] for r in got[0]} == {"a": 3, "b": 2}


@pytest.mark.parametrize("step", [4, 12])
def test_a_batch_that_stops_anywhere_leaves_nothing(spark, tmp_path, monkeypatch, step):
    """The crash comes before the n-th write; then the batch is taken again."""
    root = str(tmp_path)
    ingest_batch(log(spark, [("a", 1, 0, [push(1), push(1, type=3)])]), root, 0)
    before = tables_of(spark, root), sorted(map(str, read_snapshot(spark, root, "quarantined_events").collect()))
    second = log(spark, [("b", 1, 9, [push(1), push(2), push(2, type=3)])])
    writes = {"n": 0}

    def crash_at(name):
        real = getattr(Transaction, name)

        def write(self, *args, **kwargs):
            writes["n"] += 1
            if writes["n"] > step:
                raise OSError("lost")
            return real(self, *args, **kwargs)

        monkeypatch.setattr(Transaction, name, write)

    for name in ("append", "replace", "commit"):
        crash_at(name)
    with pytest.raises(OSError):
        ingest_batch(second, root, 1)
    monkeypatch.undo()
    assert (tables_of(spark, root), sorted(map(str, read_snapshot(spark, root, "quarantined_events").collect()))) == before
    run = ingest_batch(second, root, 1).first()
    assert counters(run)[3:6] == (1, 1, 1)
    assert read_log(spark, root, "push_events").count() == 2


def test_a_batch_that_loses_the_race_is_worked_out_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    real, raced = Transaction.commit, []

    def commit(self):
        if not raced:
            raced.append(True)
            ingest_batch(log(spark, [("other", 1, 0, [push(1), push(2)])]), root, 0, stream="other")
        return real(self)

    monkeypatch.setattr(Transaction, "commit", commit)
    run = ingest_batch(log(spark, [("mine", 1, 5, [push(2), push(3)])]), root, 0, stream="mine").first()
    assert counters(run)[3:5] == (1, 1)
    assert sorted(e["seq"] for e in read_log(spark, root, "push_events").collect()) == [1, 2, 3]


def test_known_ids_open_only_buckets_that_may_hold_them(spark, tmp_path):
    root = str(tmp_path)
    ids = spark.range(30_000).select(F.concat(F.lit("e"), F.col("id")).alias("github_event_id"))
    for batch in range(3):
        tx = Transaction(spark, root, batch)
        remember(tx, ids.where(F.col("github_event_id").endswith(str(batch))))
        tx.commit()
    tx = Transaction(spark, root, 3)
    new = ids.select(F.concat(F.lit("new"), "github_event_id").alias("github_event_id")).limit(50)
    some = ids.where("github_event_id IN ('e10', 'e21', 'e3')").unionByName(new)
    got = stored_among(tx, some)
    assert sorted(r[0] for r in got.collect()) == ["e10", "e21"]
    scanned = re.search(r"id_bucket#\d+ IN \(([^)]*)\)|id_bucket#\d+ = (\d+)", got._jdf.queryExecution().toString())
    assert len((scanned[1] or scanned[2]).split(",")) <= 4
    assert stored_among(tx, new).collect() == []
