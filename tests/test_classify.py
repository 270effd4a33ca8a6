import json

import pytest
from pyspark.sql import functions as F

from corpus import PAGE_1, SHA, log, push, without
from feedledger.operators.classify import classify, handled_types
from feedledger.plans.schedule import run_log
from feedledger.sources.pages import explode_envelopes, page_errors, page_state

CASES = {
    "absent id": (push(id=None), "missing_event_id"),
    "blank id": (push(id=""), "missing_event_id"),
    "unicode blank id": (push(id=" "), "missing_event_id"),
    "id of the wrong type": (push(id=1.5), "missing_event_id"),
    "absent actor": (push(actor=None), "invalid_actor_reference"),
    "actor no object": (push(actor=[]), "invalid_actor_reference"),
    "absent actor id": (push(actor={"id": None}), "invalid_actor_reference"),
    "text actor id": (push(actor={"id": "583231"}), "invalid_actor_reference"),
    "float actor id": (push(actor={"id": 583231.0}), "invalid_actor_reference"),
    "blank login": (push(actor={"login": ""}), "invalid_actor_reference"),
    "absent repo": (push(repo=None), "invalid_repository_reference"),
    "absent repo id": (push(repo={"id": None}), "invalid_repository_reference"),
    "blank repo name": (push(repo={"name": ""}), "invalid_repository_reference"),
    "absent created_at": (push(created_at=None), "invalid_occurred_at"),
    "unreadable created_at": (push(created_at="yesterday"), "invalid_occurred_at"),
    "numeric created_at": (push(created_at=1753790292), "invalid_occurred_at"),
    "payload no object": (push(payload=[]), "missing_required_field"),
    "null push id": (push(payload={"push_id": None}), "missing_required_field"),
    "blank ref": (push(payload={"ref": ""}), "invalid_field_format"),
    "numeric ref": (push(payload={"ref": 42}), "invalid_field_format"),
    "head no hex": (push(payload={"head": "not-a-valid-object-name"}), "invalid_field_format"),
    "head with a newline": (push(payload={"head": SHA + "\n"}), "invalid_field_format"),
    "before too short": (push(payload={"before": "abc123"}), "invalid_field_format"),
    "text push id": (push(payload={"push_id": "27500000001"}), "invalid_field_format"),
    "other repository": (push(payload={"repository_id": 999999}), "repository_id_mismatch"),
    "wide push id": (push(payload={"push_id": 2**63}), "identifier_out_of_range"),
    "very wide push id": (push(payload={"push_id": 10**50}), "identifier_out_of_range"),
    "text repository id": (push(payload={"repository_id": "1296269"}), "invalid_field_format"),
    "id before payload": (push(id=None, payload={"head": None}), "missing_event_id"),
    "absence before shape": (push(payload={"head": None, "before": "abc123"}), "missing_required_field"),
    "a null": (None, "invalid_envelope"),
    "a number": (3, "invalid_envelope"),
    "an array": ([1], "invalid_envelope"),
    "no type": (without(push(), "type"), "missing_event_type"),
    "numeric type": (push(type=7), "missing_event_type"),
    "largest ids": (push(payload={"push_id": 2**63 - 1}), None),
    "long head": (push(payload={"head": "F" * 64}), None),
    "integer id": (push(id=58000000001), None),
    "wrong optional": (push(actor={"display_login": {"odd": True}}), None),
    "healthy but unprintable": (json.dumps(push()).replace('"public": true', '"weight": 1e400'), None),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    bodies = ["[" + (v if isinstance(v, str) else json.dumps(v)) + "]" for v, _ in CASES.values()]
    rows = classify(explode_envelopes(log(spark, [(name, 1, 0, body) for name, body in zip(CASES, bodies)]))).collect()
    return {row["run_id"]: row for row in rows}


@pytest.mark.parametrize("name", CASES)
def test_taxonomy(verdicts, name):
    expected, row = CASES[name][1], verdicts[name]
    assert row["error_code"] == expected
    assert row["outcome"] == ("push_event" if expected is None else "quarantined")
    assert (row["payload_fingerprint"] is None) == (expected is None)


def test_messages_name_every_broken_rule(verdicts):
    assert verdicts["id before payload"]["error_message"] == "id is absent; payload is missing head"
    assert verdicts["other repository"]["error_message"] == \
        "payload.repository_id 999999 does not match repo.id 1296269"
    assert verdicts["head no hex"]["error_message"] == \
        'payload.head is "not-a-valid-object-name", not 40 or 64 hexadecimal characters'
    assert "does not match" not in verdicts["text repository id"]["error_message"]
    assert verdicts["a null"]["error_message"] == "event is NilClass, not a JSON object"
    assert verdicts["a null"]["raw_payload"] is None
    assert verdicts["numeric type"]["error_message"] == "type is Integer"
    assert verdicts["actor no object"]["error_message"] == "actor is a Array"
    assert verdicts["very wide push id"]["error_message"] == f"payload.push_id {10**50} exceeds a 64-bit identifier"
    assert verdicts["float actor id"]["error_message"] == "actor.id is 583231.0"
    assert verdicts["integer id"]["github_event_id"] == "58000000001"
    assert verdicts["wrong optional"]["actor"]["display_login"] is None


def test_corpus_page(spark):
    rows = classify(explode_envelopes(log(spark, [("r", 1, 0, PAGE_1)]))).collect()
    outcomes = [row["outcome"] for row in sorted(rows, key=lambda r: r["pos"])]
    assert outcomes == ["push_event"] * 3 + ["ignored"] + ["quarantined"] * 3 + ["push_event"]
    assert sum(row["push_typed"] for row in rows) == 6
    codes = {row["error_code"] for row in rows if row["error_code"]}
    assert codes == {"missing_required_field", "invalid_field_format", "missing_event_type"}


def test_unstorable_envelopes_fail(spark):
    nul = json.dumps(push(payload={"ref": "a\x00b"}))
    infinite = json.dumps(without(push(2), "payload", "head")).replace('"public": true', '"w": 1e400')
    fragment = json.dumps(push(3)).replace('"id": 583231', '"id": 583231, "w": 1e400')
    ignored = json.dumps(push(4, type="WatchEvent", note="a\x00b"))
    literal = json.dumps(push(5, note="\\u0000"))
    body = "[" + ",".join([nul, infinite, fragment, ignored, literal]) + "]"
    rows = sorted(classify(explode_envelopes(log(spark, [("r", 1, 0, body)]))).collect(), key=lambda r: r["pos"])
    assert [r["outcome"] for r in rows] == ["failed", "failed", "push_event", "ignored", "push_event"]
    assert [r["fragment_undefined"] for r in rows] == [False, False, True, False, False]


def test_page_errors(spark):
    bad = {"object": '{"a":1}', "tail": "[1] [2]", "cut": "[1", "double": "[1],[2]", "float tail": "[1.0] x",
           "nan": "[NaN]", "text": "busy", "empty": ""}
    good = {"array": " [1, 2]\n", "none": "[]"}
    pages = log(spark, [(name, 1, 0, body) for name, body in {**bad, **good}.items()])
    assert {r["run_id"] for r in page_errors(pages).collect()} == set(bad)


def nested(levels, leaf):
    """An array page nested ``levels`` deep."""
    return "[" * levels + leaf + "]" * levels


def test_walk_and_explode_judge_nesting_alike(spark):
    wide = "[" + ",".join(["[[[[[[[[[1]]]]]]]]]"] * 60) + "]"
    good = {"plain 100": nested(100, "1"), "float 100": nested(100, "1.0"), "wide": wide,
            "brackets in text": "[" + json.dumps("[{" * 300) + "]"}
    bad = {"plain 101": nested(101, "1"), "float 101": nested(101, "1.0"),
           "objects": "[" + '{"a":' * 100 + "1" + "}" * 100 + "]"}
    pages = log(spark, [(name, 1, 0, body) for name, body in {**good, **bad}.items()])
    assert {r["run_id"] for r in page_state(pages).where("is_array").collect()} == set(good)
    assert {r["run_id"] for r in explode_envelopes(pages).collect()} == set(good)
    assert {r["run_id"] for r in page_errors(pages).collect()} == set(bad)
    assert {r["run_id"] for r in run_log(pages).where("http_class = 'malformed_page'").collect()} == set(bad)


def test_walk_reads_a_page_past_the_variant_limit(spark):
    body = F.concat(F.lit('["'), F.repeat(F.lit("x"), 130 * 1024 * 1024), F.lit('"]'))
    pages = log(spark, [("r", 1, 0, "[]")]).withColumn("body", body)
    assert [r["is_array"] for r in page_state(pages).select("is_array").collect()] == [True]


def test_repository_names(spark):
    names = {"octo/hello": ("hello", "octo"), "octo/": ("octo", "octo"), "/": (None, ""), "plain": (None, None),
             "/a": ("a", ""), "a/b/c": ("c", "a"), "a//": ("a", "a")}
    pages = log(spark, [(n, 1, 0, [push(repo={"name": n})]) for n in names])
    rows = classify(explode_envelopes(pages)).select("repository").collect()
    assert {r[0]["full_name"]: (r[0]["name"], r[0]["owner_login"]) for r in rows} == names


def test_handled_types():
    assert handled_types([" PushEvent ", "PushEvent"]) == ("PushEvent",)
    for bad in ([], [" "], ["ForkEvent"]):
        with pytest.raises(ValueError):
            handled_types(bad)
