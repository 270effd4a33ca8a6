"""Walks that go on over batches, on page states alone."""

import random

import pytest
from pyspark.sql import functions as F

from feedledger.schemas import WALKS
from feedledger.session import stage
from feedledger.sources.pages import stops_of, walked

STATE = ("run_id string, page_no int, request_url string, http_class string, is_array boolean, is_empty boolean, next_url string")


def states(seed: int, runs: int) -> list[tuple]:
    """Runs of up to eight pages that end in every way, or not at all."""
    rnd, rows = random.Random(seed), []
    for run in range(runs):
        for page in range(1, rnd.randint(2, 9)):
            kind = rnd.random()
            link = None if kind < 0.08 else f"https://x/e?page={rnd.randint(0, page) if kind < 0.2 else page + 1}"
            rows.append((f"r{run}", page, f"https://x/e?page={page}", "rate_limited" if kind > 0.97 else "ok",
                         kind < 0.9 or kind > 0.95, 0.85 < kind < 0.9, link))
    return rows


@pytest.mark.parametrize("cap", [None, 3])
def test_walks_in_pieces_end_like_whole_ones(spark, cap):
    rows = states(1, 60)
    whole = {r["run_id"]: r for r in stops_of(spark.createDataFrame(rows, STATE), cap).collect()}
    walks = spark.createDataFrame([], WALKS)
    counted = set()
    for first, last in ((1, 2), (3, 3), (4, 6), (7, 9)):
        own = spark.createDataFrame([r for r in rows if first <= r[1] <= last], STATE)
        stops = stage(stops_of(own, cap, walks), "stops")
        counted |= {tuple(r) for r in own.join(stops, "run_id").where("page_no <= counted_through").select("run_id", "page_no").collect()}
        new = walked(own, stops, walks)
        walks = stage(new.unionByName(walks.join(new.select("run_id"), "run_id", "left_anti")), "walks")
    got = {r["run_id"]: r for r in walks.collect()}
    assert {k: (r["stop_page"], r["stop_reason"], r["counted_through"]) for k, r in got.items()} == {
        k: (r["stop_page"], r["stop_reason"], r["counted_through"]) for k, r in whole.items()}
    assert counted == {(r[0], r[1]) for r in rows if r[1] <= whole[r[0]]["counted_through"]}
    assert {r["stop_reason"] for r in whole.values()} >= {"page_error", "empty_page", "link_loop", None}
    assert all((r["visited"] is None) == (r["stop_reason"] is not None) for r in got.values())
    assert all(r["first_page"] == 1 and r["first_class"] in ("ok", "rate_limited") for r in got.values())


def test_a_cap_holds_over_batches(spark):
    one = spark.createDataFrame([("a", 1, "https://x/e?page=1", "ok", True, False, "https://x/e?page=2")], STATE)
    stops = stops_of(one, 1)
    walks = stage(walked(one, stops, spark.createDataFrame([], WALKS)), "walks")
    two = one.withColumn("page_no", F.lit(2)).withColumn("next_url", F.lit(None).cast("string"))
    assert stops_of(two, 1, walks).first()["counted_through"] == 1
