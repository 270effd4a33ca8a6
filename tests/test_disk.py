"""What a batch and its landing leave on disk: texts are staged once, and no shuffle outlives its job."""

import os
import time

import pytest
from pyspark.sql import functions as F

from corpus import log, nxt, push
from feedledger.operators import ingest, known_ids, ranking
from feedledger.operators.ingest import ingest_batch
from feedledger.sources.pages import read_fetch_log
from feedledger.sources.tables import read_log
from feedledger.workload import report_queries

PAGES = [("a", 1, 0, [push(1), push(2), push(1), push(3, type=3)], nxt(2)), ("a", 2, 1, [push(2), push(4)]),
         ("b", 1, 2, [push(4), push(5)], nxt(2)), ("b", 2, 3, "[]"), ("b", 3, 4, [push(6)])]


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}


@pytest.fixture
def staged(monkeypatch):
    """Columns and plan of what a batch stages, by label and the first of each."""
    found = {}

    def spy(real):
        def stage(df, label, *rest):
            found.setdefault(label, (df.columns, df._jdf.queryExecution().executedPlan().toString()))
            return real(df, label, *rest)
        return stage

    for module in (ingest, known_ids, ranking):
        monkeypatch.setattr(module, "stage", spy(module.stage))
    return found


def test_texts_are_staged_once_and_bodies_are_not_shuffled(spark, tmp_path, staged):
    ingest_batch(log(spark, PAGES), str(tmp_path), 0)
    texts = {"actor_fragment", "repo_fragment"}
    assert [label for label, (columns, _) in staged.items() if texts & set(columns)] == ["classified"]
    assert "SortMergeJoin" not in staged["classified"][1]
    events = read_log(spark, str(tmp_path), "push_events").orderBy("seq").collect()
    assert [(e["seq"], e["github_event_id"][-2:]) for e in events] == [(1, "01"), (2, "02"), (3, "04"), (4, "05")]
    assert all(e["github_event_id"] in e["raw_payload"] for e in events)


def test_a_batch_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    ingest_batch(log(spark, PAGES), str(tmp_path), 0)
    until = time.time() + 20  # they are removed in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.5)
    assert not shuffle_files(spark) - before


def test_a_page_that_comes_twice_creates_its_events_once(spark, tmp_path):
    run = ingest_batch(log(spark, [PAGES[0], PAGES[0]]), str(tmp_path), 0).first()
    assert run["events_received"] == 8
    events = read_log(spark, str(tmp_path), "push_events").collect()
    assert sorted(e["github_event_id"][-2:] for e in events) == ["01", "02"]
    assert read_log(spark, str(tmp_path), "observations").count() == 4


def test_landed_pages_are_compressed_and_whole(spark, tmp_path):
    pages = log(spark, PAGES)
    report_queries._land(pages.withColumn("run", F.lit(0)), str(tmp_path / "landing"))
    files = [f for f in os.listdir(tmp_path / "landing") if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    names = ["run_id", "page_no", "received_at", "status", "body"]
    got = read_fetch_log(spark, str(tmp_path / "landing")).select(names)
    assert sorted(got.collect()) == sorted(pages.select(names).collect())


def test_ids_meet_the_filters_without_a_shuffle(spark):
    ids = spark.range(3000).select(F.concat(F.lit("e"), "id").alias("github_event_id"))
    placed = ids.withColumn("id_bucket", known_ids.id_bucket(F.col("github_event_id")))
    stored = placed.where("github_event_id LIKE '%7'")
    bloom = known_ids.probes(stored).groupBy("id_bucket", "word").agg(F.bit_or("bit").alias("bits"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if both sides were large
    try:
        maybe = known_ids.maybe_known(placed, bloom)
        assert stored.exceptAll(maybe.select(stored.columns)).count() == 0
        assert 300 <= maybe.count() < 330
        assert "SortMergeJoin" not in maybe._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
