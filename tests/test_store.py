"""Replays, pointers and first pages on inputs the feed never produces."""

import pytest

from feedledger.plans.schedule import run_log, source_health
from feedledger.schemas import FETCH_LOG, TABLES
from feedledger.sources import commits, tables
from pyspark.sql import functions as F


def _events(spark, days):
    schema = TABLES["push_events"]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_timestamp("d").alias("t"))
    return rows.select(*[(F.col("t") if f.name == "created_at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def test_replay_with_fewer_days_keeps_no_old_row(spark, tmp_path):
    root = str(tmp_path)
    tables.append_log(_events(spark, ["2024-01-01"]), root, "push_events", 0)
    tables.append_log(_events(spark, ["2024-01-01", "2024-01-02"]), root, "push_events", 1)
    tables.append_log(_events(spark, ["2024-01-02"]), root, "push_events", 1)
    assert tables.read_log(spark, root, "push_events").count() == 2
    tables.append_log(_events(spark, []), root, "push_events", 1)
    assert tables.read_log(spark, root, "push_events").count() == 1


def test_only_a_manifest_makes_rows_live(spark, tmp_path):
    root, schema = str(tmp_path), TABLES["actors"]
    frame = spark.range(3).select(*[(F.col("id") if f.name == "github_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    commits.Transaction(spark, root, 0).replace(frame, "actors")
    assert tables.read_snapshot(spark, root, "actors").count() == 0
    tables.swap_snapshot(frame, root, "actors", 0)
    left = commits.Transaction(spark, root, 1)
    left.replace(frame.limit(1), "actors")
    assert tables.read_snapshot(spark, root, "actors").count() == 3
    assert tables.read_snapshot(spark, root, "actors", before=2).count() == 3
    assert tables.read_snapshot(spark, root, "actors", before=0).count() == 0
    left.commit()
    assert tables.read_snapshot(spark, root, "actors").count() == 1
    assert tables.read_snapshot(spark, root, "actors", before=1).count() == 3


def test_older_batches_are_refused(spark, tmp_path):
    root = str(tmp_path)
    tables.append_log(_events(spark, ["2024-01-01"]), root, "push_events", 5)
    with pytest.raises(commits.BatchRefused):
        tables.append_log(_events(spark, ["2024-01-02"]), root, "push_events", 4)
    assert tables.read_log(spark, root, "push_events").count() == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path)
    one, two = (commits.Transaction(spark, root, 0) for _ in range(2))
    one.append(_events(spark, ["2024-01-01"]), "push_events")
    two.append(_events(spark, ["2024-01-02", "2024-01-03"]), "push_events")
    one.commit()
    with pytest.raises(commits.CommitConflict):
        two.commit()
    assert tables.read_log(spark, root, "push_events").count() == 1


def test_ledger_numbers(spark, tmp_path):
    root = str(tmp_path)
    assert commits.claim_batch(spark, root, "a", 0) == (0, False)
    assert commits.claim_batch(spark, root, "a", 0) == (0, False)  # tried again after a crash
    assert commits.claim_batch(spark, root, "b", 0) == (1, False)  # another checkpoint
    tx = commits.Transaction(spark, root, 0, "a", 0)
    tx.append(_events(spark, ["2024-01-01"]), "push_events")
    tx.commit()
    assert commits.claim_batch(spark, root, "a", 0) == (0, True)
    assert commits.claim_batch(spark, root, "b", 0) == (1, False)
    number, _ = commits.claim_batch(spark, root, "a", 1)
    tx = commits.Transaction(spark, root, number, "a", 1)
    tx.commit()
    with pytest.raises(commits.BatchRefused):
        commits.claim_batch(spark, root, "a", 0)


def test_create_text_never_overwrites(spark, tmp_path):
    path = f"{tmp_path}/deep/x.json"
    assert commits.create_text(spark, path, "one") and not commits.create_text(spark, path, "two")
    assert commits.read_text(spark, path) == "one"


def test_compacted_log_keeps_rows_and_days(spark, tmp_path):
    root = str(tmp_path)
    for batch in range(4):
        tables.append_log(_events(spark, [f"2024-01-0{batch + 1}", "2024-01-09"]), root, "push_events", batch)
    assert commits.compact_log(spark, root, "push_events") == 3
    manifest = commits.read_manifest(spark, root)
    assert [b for _, b in manifest.tables["push_events"].parts] == [2, 3]
    assert tables.read_log(spark, root, "push_events").count() == 8
    assert tables.read_log(spark, root, "push_events", since=F.lit("2024-01-04")).count() == 5
    commits.expire(spark, root)
    assert tables.read_log(spark, root, "push_events").count() == 8


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    root, schema = str(tmp_path), TABLES["actors"]
    frame = spark.range(400).select(*[(F.col("id") if f.name == "github_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    tables.swap_snapshot(frame, root, "actors", 0)
    tx = commits.Transaction(spark, root, 1)
    touched = tx.touched("actors", frame.where("github_id = 7"), "github_id")
    assert len(touched) == 1
    opened = tx.rows("actors", touched)
    assert 0 < opened.count() < 100 and len(opened.inputFiles()) == commits.BUCKETS  # listed, and one bucket read
    tx.replace(opened.withColumn("login", F.lit("new")), "actors", touched)
    tx.commit()
    state = commits.read_manifest(spark, root).tables["actors"]
    assert len(set(state.buckets)) == 2 and state.buckets.count(state.buckets[touched[0]]) == 1
    rows = tables.read_snapshot(spark, root, "actors")
    assert rows.count() == 400 and rows.where("github_id = 7").first()["login"] == "new"


def test_a_malformed_first_page_is_a_failure(spark):
    values = {"run_id": "r", "source_id": 1, "page_no": 1, "status": 200, "body": '{"message": "no"}'}
    row = spark.range(1).select(*[(F.lit(values[f.name]).cast(f.dataType) if f.name in values else
                                   F.current_timestamp().cast(f.dataType) if f.name == "received_at" else
                                   F.lit(None).cast(f.dataType)).alias(f.name) for f in FETCH_LOG])
    health = source_health(run_log(row)).first()
    assert health["consecutive_failures"] == 1 and health["last_success_at"] is None
