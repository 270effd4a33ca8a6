"""Page bodies: the quick writer against the slow one, the array test against the decoder."""

import json
import random

import pyarrow as pa

from feedledger.functions import decoder
from feedledger.functions.decoder import _element, decode_array, is_array_body

BODIES = (
    '[]', ' [ ] ', '{}', 'null', '7', '"x"', '', 'x', '[1] x', '[NaN]', '[1,]', '﻿[]', '[1.0, {"a": 2e3}]',
    '[{"b": 1, "a": {"d": "\\u00e9", "c": "\\n\\u001f\\u007f"}, "actor": {"y": 1, "x": 2}, "repo": null}]',
    '[{"\\ud83d\\ude00": 1, "\\uffff": 2, "actor": "\\ud83d", "repo": "\\u0000"}]', '["\\\\u0000", "[{[{", null, true]',
    '[9223372036854775808, -0, 123456789012345678901234567890]', '[{"a": 1, "a": {"b": 2}}]',
    '[' * 100 + ']' * 100, '[' * 101 + ']' * 101, '[' * 3000, '[{"a":' * 49 + '[[]]' + '}]' * 49, '[{"a":' * 50 + '[]' + '}]' * 50,
    '[' + ','.join(['{"a":{"b":[{}]}}'] * 200) + ']')


def test_the_quick_writer_gives_what_the_slow_one_gives():
    for body in BODIES:
        found = decode_array(body)
        assert is_array_body(body) == (found is not None and found[1] is not None), body
        if found and found[1]:
            assert found[1] == [tuple(_element(item, 1).values()) for item in decoder._parse(body)]
    assert decode_array(None) is None and not is_array_body(None)


def test_a_batch_of_bodies_keeps_its_rows():
    bodies = [None, "[1,2]", "x", "[]", "{}", '["\\ud83d"]']
    rows = decoder.decode_array_bodies.func(pa.array(bodies, type=pa.string())).to_pylist()
    texts = [r["elements"] and [e["text"] for e in r["elements"]] for r in rows]
    assert texts == [None, ["1", "2"], None, [], None, ['"?"']]
    assert [r["head"] is None for r in rows] == [True, False, True, False, False, False]


def test_plain_pages_are_written_by_the_quick_writer(monkeypatch):
    body = "[" + ",".join('{"id":"%d","actor":{"id":%d}}' % (i, random.Random(i).randrange(9)) for i in range(100)) + "]"
    monkeypatch.setattr(decoder, "_write", lambda value, facts, depth=0: "[]" if value == [] else 1 / 0)
    assert len(decode_array(body)[1]) == 100


def test_fields_of_an_envelope_are_those_of_its_canonical_text():
    """Kinds and texts against a plain reading of the canonical text, path by path."""
    kinds = {str: "string", int: "integer", bool: "boolean", float: "float", dict: "object", list: "array", type(None): "null"}
    odd = [7, -0.0, 1e400, True, None, "", "é", "\ud83d", "\x00", [1], {"a": 1}, 10**40, 2**63, "x"]
    items = [None, 3, 1.5, "x", [1], {}, {"actor": [], "repo": "x", "payload": None}]
    items += [{key: value, "actor": {"id": value, "login": value}, "payload": {"push_id": value}, "repo": {"name": value}}
              for value in odd for key in ("id", "type", "created_at", "actor")]
    rows = decoder.decode_array_bodies.func(pa.array(["[" + json.dumps(i).replace("Infinity", "1e400") + "]" for i in items])).to_pylist()
    for item, row in zip(items, rows):
        found = row["elements"][0]
        whole = json.loads(found["text"])
        assert found["k_document"] == kinds[type(whole)], item
        for name, path in decoder.ENVELOPE_PATHS.items():
            value, there = whole, True
            for key in path.split(".")[1:]:
                there = there and isinstance(value, dict) and key in value
                value = value[key] if there else None
            assert found[f"k_{name}"] == (kinds[type(value)] if there else "absent"), (item, name)
            if name not in decoder.CONTAINERS:
                text = {"string": value, "integer": str(value), "boolean": json.dumps(value)}
                assert found[f"s_{name}"] == text.get(found[f"k_{name}"]), (item, name)


def test_problems_of_pages_need_no_elements(monkeypatch):
    monkeypatch.setattr(decoder, "_plain_element", lambda item: 1 / 0)
    rows = decoder.array_problems.func(pa.array([None, "[1,2]", "x", '{"a":1}'])).to_pylist()
    assert [r["is_array"] for r in rows] == [False, True, False, False]
    assert [r["head"] and r["head"]["text"] for r in rows] == [None, None, None, '{"a":1}']
