"""The derived feed is built by many tasks, and only narrow events are shuffled for it."""

import pytest
from pyspark.sql import functions as F

from feedledger.workload import feed


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("feed"))
    rows = spark.range(3500).coalesce(1).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


def test_one_file_of_events_is_built_by_many_tasks(spark, one_file):
    pages = feed.fetch_log(spark, one_file)
    spread = pages.groupBy(F.spark_partition_id()).count().count()
    assert spread > 1
    plan = pages._jdf.queryExecution().executedPlan().toString()
    keys = [part.split(")")[0] for part in plan.split("Exchange hashpartitioning(")[1:]]
    assert len(keys) == 1 and "page_no" not in keys[0]


def test_pages_hold_all_deliveries_in_order(spark, one_file):
    pages = feed.fetch_log(spark, one_file)
    found = pages.select("run", "page_no", F.from_json("body", "array<struct<payload:struct<push_id:long>>>").alias("b")).select(
        "run", "page_no", "b.payload.push_id")
    got = {(r.run, r.page_no): r.push_id for r in found.collect()}
    want = {}
    for n in range(3500):
        for page in [1 + n // 100 % 10] + [11] * (n % 10 == 0):
            want.setdefault((n // 1000, page), []).append(None if n and n % 593 == 0 or n == 0 else n)
    assert got.keys() == want.keys()
    assert all([g for g in got[k] if g] == [w for w in want[k] if w] and len(got[k]) == len(want[k]) for k in want)
