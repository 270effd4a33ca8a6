import hashlib
import json

from corpus import log
from feedledger.functions.decoder import decode_body
from feedledger.operators.classify import read_fields
from feedledger.sources.pages import explode_envelopes

TEXTS = {
    '{"b": [1, {"d": null, "c": true}], "a": "é"}': '{"a":"é","b":[1,{"c":true,"d":null}]}',
    '{"é":1,"z":2,"a":3,"Z":4}': '{"Z":4,"a":3,"z":2,"é":1}',
    "[3, 1, 2]": "[3,1,2]",
    '{"n": 1.0}': '{"n":1.0}', '{"n": 1}': '{"n":1}',
    '{"n": 1e2}': '{"n":100.0}', '{"n": 1e-7}': '{"n":1.0e-07}', '{"n": 1.5E+16}': '{"n":1.5e+16}',
    '{"n": 0.0001}': '{"n":0.0001}', '{"n": -0.0}': '{"n":-0.0}', '{"n": -0}': '{"n":0}',
    '{"n": 123456789012345678901234567890123456789012}': '{"n":123456789012345678901234567890123456789012}',
    '{"n": 9223372036854775807}': '{"n":9223372036854775807}',
    '{"k": "a\\u001Fb\\n"}': '{"k":"a\\u001fb\\n"}',
    '{"a": 1, "a": 2}': '{"a":2}',
    '{"\U0001f600": 1, "￮": 2}': '{"￮":2,"\U0001f600":1}',
    '{"k": "\U0001f600 : 1.5, \\u00e9 \\/"}': '{"k":"\U0001f600 : 1.5, é /"}',
    '"x"': '"x"', "null": "null", "5": "5", "[]": "[]", "{}": "{}",
}
TRIPWIRE = "419018b114d9c9219b9a1c2662a692fae509085787bd07f914579861ae91747f"


def test_canonical_text_on_both_ways(spark):
    pages = log(spark, [(str(i), 1, 0, f"[{text}]") for i, text in enumerate(TEXTS)])
    got = {int(r["run_id"]): r["canonical_text"]
           for r in read_fields(explode_envelopes(pages)).select("run_id", "canonical_text").collect()}
    assert [got[i] for i in range(len(TEXTS))] == list(TEXTS.values())
    for text, canonical in TEXTS.items():
        assert decode_body(f"[{text}]")["elements"][0]["text"] == canonical


def test_tripwire():
    text = next(iter(TEXTS.values()))
    assert hashlib.sha256(text.encode()).hexdigest() == TRIPWIRE


def test_undefined_and_unstorable():
    element = decode_body('[{"actor": {"w": 1e400}, "repo": {}}]')["elements"][0]
    assert (element["undefined"], element["actor_undefined"], element["repo_undefined"]) == (True, True, False)
    assert json.loads(element["text"]) == {"actor": {"w": None}, "repo": {}}
    assert decode_body('["\\ud83d"]')["elements"][0]["undefined"]
    assert decode_body('["\\u0000"]')["elements"][0]["unstorable"]
    assert decode_body("[" * 101 + "]" * 101) is None
    assert decode_body("[1] x") is None
