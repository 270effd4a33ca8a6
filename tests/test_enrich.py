import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpus import NOON, PAGE_1, log
from feedledger.operators import enrich_job, selection
from feedledger.operators.enrich import apply_detail_answers, apply_search_answers
from feedledger.operators.ingest import ingest_batch
from feedledger.operators.transitions import hold_leases
from feedledger.session import stage
from feedledger.sources.documents import ANSWER_LOG
from feedledger.sources.tables import read_log, read_snapshot

def at_one():
    return F.lit(NOON + dt.timedelta(hours=1))


def repository(github_id, full_name, **changes):
    return {"id": github_id, "full_name": full_name, "owner": {"id": 1, "login": full_name.split("/")[0]},
            "fork": False, "archived": False, "default_branch": "main", "description": None, "language": "Ruby",
            "created_at": "2011-01-26T19:01:12Z", "score": 1.0, **changes}


ITEMS = {
    "actor": [{"id": 583231, "login": "OCTO", "type": "User", "score": 1.0}, {"id": 1024025, "login": "mona", "type": "User"}],
    "repository": [repository(1296269, "octo/hello"), repository(1300192, "mona/spoon")],
}
LEFT = {"actor": 7700421, "repository": 1490033}


def answer(spark, batch_id, status, body, error=None):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    return spark.createDataFrame([(batch_id, NOON, status, {}, text, *(error or (None, None)))], ANSWER_LOG)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    ingest_batch(log(spark, [("a", 1, 0, PAGE_1)]), folder, 0)
    return folder


def claimed(spark, root, kind):
    entities = read_snapshot(spark, root, {"actor": "actors", "repository": "repositories"}[kind])
    members = stage(selection.leases_for(selection.plan_members(kind, entities, at_one()), at_one()), "members")
    return stage(hold_leases(entities, members), "held"), selection.open_batches(members, "search", at_one()), members


def search(spark, root, kind, body, status=200, **kwargs):
    entities, batches, members = claimed(spark, root, kind)
    batch_id = members.first()["request_batch_id"]
    return apply_search_answers(kind, entities, batches, members, answer(spark, batch_id, status, body, **kwargs), at_one())


def document(items, **changes):
    return {"total_count": len(items), "incomplete_results": False, "items": items, **changes}


@pytest.mark.parametrize("kind", ["actor", "repository"])
def test_partial_answer_then_a_gone_entity(spark, root, kind):
    done = search(spark, root, kind, document(ITEMS[kind]))
    batch = done.batches.first()
    assert (batch["status"], batch["returned_count"], batch["valid_count"], batch["missing_count"]) == ("succeeded", 2, 2, 1)
    assert {r["validation_outcome"] for r in done.observations.collect()} == {"applied"}
    entities = stage(done.entities, "entities")
    waiting = entities.where("enrichment_stage = 'detail_pending'").collect()
    assert [(r["github_id"], r["last_error"], r["enrichment_status"]) for r in waiting] == [
        (LEFT[kind], "missing_search_result", "pending")]
    members = stage(selection.leases_for(selection.plan_details(kind, entities, at_one()), at_one()), "members")
    held = hold_leases(entities, members, "detail_in_flight")
    gone = apply_detail_answers(kind, held, selection.open_batches(members, "detail", at_one()), members,
                                answer(spark, members.first()["request_batch_id"], 404, "{}"), at_one())
    states = {r["github_id"]: (r["enrichment_status"], r["enrichment_stage"], r["last_error"]) for r in gone.entities.collect()}
    assert states.pop(LEFT[kind]) == ("permanent_failure", "terminal", "entity_gone_404")
    assert set(states.values()) == {("complete", "contract_complete", None)}


def test_renamed_and_unrequested_repositories(spark, root):
    items = [repository(1296269, "octo/renamed"), repository(1300192, "MONA/spoon"), repository(5, "no/body")]
    done = search(spark, root, "repository", document(items, incomplete_results=True))
    outcomes = {r["entity_github_id"]: r["validation_outcome"] for r in done.observations.collect()}
    assert outcomes == {1296269: "renamed_repository", 1300192: "applied", 5: "unrequested_result"}
    batch = done.batches.first()
    assert (batch["valid_count"], batch["missing_count"], batch["invalid_count"], batch["incomplete_results"]) == (1, 1, 2, True)


def test_first_item_wins_and_a_name_match_of_another_id_is_refused(spark, root):
    items = [{"id": 9, "login": "octo", "type": "User"}, {"id": 1024025, "login": "x", "type": "User"},
             {"id": 1024025, "login": "mona", "type": ""}]
    done = search(spark, root, "actor", document(items))
    reasons = {r["github_id"]: r["last_error"] for r in done.entities.collect()}
    assert reasons == {583231: "identity_mismatch", 1024025: None, 7700421: "missing_search_result"}


@pytest.mark.parametrize("status, body, error, verdict, stage_after", [
    (200, {"total_count": "1", "incomplete_results": False, "items": []}, None, "malformed", "retry_scheduled"),
    (200, "[1]", None, "malformed", "retry_scheduled"),
    (503, "busy", None, "failed", "retry_scheduled"),
    (422, '{"message":"users cannot be searched"}', None, "rejected", "detail_pending"),
    (429, "{}", None, "deferred", "batch_pending"),
    (None, None, ("transport_error", "timed out"), "failed", "retry_scheduled"),
    (None, None, ("budget_denied", "no quota"), "deferred", "batch_pending"),
])
def test_answers_that_bring_nothing(spark, root, status, body, error, verdict, stage_after):
    done = search(spark, root, "actor", body, status, error=error)
    assert done.results.first()["verdict"] == verdict
    rows = done.entities.collect()
    assert {r["enrichment_stage"] for r in rows} == {stage_after} and {r["lease_token"] for r in rows} == {None}


def test_an_item_that_cannot_be_recorded_abandons_the_batch(spark, root):
    body = json.dumps(document(ITEMS["actor"])).replace("1.0", "1e400")
    done = search(spark, root, "actor", body)
    assert done.results.first()["verdict"] == "abandoned" and done.observations.count() == 0
    assert {r["enrichment_stage"] for r in done.entities.collect()} == {"batch_pending"}


def test_planning_and_answers_on_stored_tables(spark, tmp_path):
    """Two planners, one answer, the same answer again, and a single lookup for what is left."""
    folder = str(tmp_path)
    ingest_batch(log(spark, [("a", 1, 0, PAGE_1)]), folder, 0)
    assert tuple(enrich_job.plan_enrichment(spark, folder, "actor", at_one()).first()) == ("actor", 1, 3)
    assert enrich_job.plan_enrichment(spark, folder, "actor", at_one()).first()["leased"] == 0
    batch = read_snapshot(spark, folder, "batches").first()
    said = answer(spark, batch["correlation_id"], 200, document(ITEMS["actor"]))
    enrich_job.apply_answers(spark, folder, "actor", said, at_one())
    enrich_job.apply_answers(spark, folder, "actor", said, at_one())
    batch = read_snapshot(spark, folder, "batches").first()
    assert (batch["status"], batch["valid_count"], batch["missing_count"]) == ("succeeded", 2, 1)
    states = {r["github_id"]: r["enrichment_stage"] for r in read_snapshot(spark, folder, "actors").collect()}
    assert states == {583231: "contract_complete", 1024025: "contract_complete", LEFT["actor"]: "detail_pending"}
    found = read_log(spark, folder, "observations").where("source = 'search'").collect()
    assert {r["entity_github_id"] for r in found} == {583231, 1024025} and len(found) == 2
    assert enrich_job.plan_enrichment(spark, folder, "actor", at_one(), "detail").first()["leased"] == 1
    lookup = read_snapshot(spark, folder, "batches").where("request_kind = 'detail'").first()
    enrich_job.apply_answers(spark, folder, "actor", answer(spark, lookup["correlation_id"], 404, "{}"), at_one(), "detail")
    gone = read_snapshot(spark, folder, "actors").where(F.col("github_id") == LEFT["actor"]).first()
    assert (gone["enrichment_stage"], gone["lease_token"]) == ("terminal", None)
