"""Exact JSON decoding of page bodies, and of the few answers Spark's JSON printer cannot reproduce.

Canonical text is compact with sorted keys. Bodies of pages all pass through an Arrow-batched
decoder: Spark's printer of variants sets up a JSON generator for every string of every
envelope, which takes several times as long. Answers to lookups are printed by Spark, which is
exact except for float tokens, integers beyond 18 digits, control and surrogate escapes, and keys
outside the basic plane. ``needs_exact_decoder`` finds such bodies, and those that may nest
deeper than ``MAX_NESTING``, which the decoder refuses; they alone take the decoder there.

Float text is one fixed rule because it decides row identity: shortest digits that read
back to the same double; plain notation from 1e-4 up to 1e16, otherwise one digit, a
point, the remaining digits (at least one) and an exponent with sign and two digits.
"""

from __future__ import annotations

import json
import math
import sys
from json.encoder import encode_basestring
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Ship the decoder itself to the executors, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A parsed variant is limited in size; larger bodies take the decoder instead.
NATIVE_BODY_LIMIT = 8 * 1024 * 1024
MAX_NESTING = 100
PEELED_LEVELS = 8

ELEMENT_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("actor_text", T.StringType()),
    T.StructField("repo_text", T.StringType()),
    T.StructField("undefined", T.BooleanType()),
    T.StructField("actor_undefined", T.BooleanType()),
    T.StructField("repo_undefined", T.BooleanType()),
    T.StructField("unstorable", T.BooleanType()),
])
DOCUMENT_TYPE = T.StructType([
    T.StructField("head", ELEMENT_TYPE),
    T.StructField("elements", T.ArrayType(ELEMENT_TYPE)),
])

# The fields of an envelope that classification looks at.
ENVELOPE_PATHS = {
    "id": "$.id", "type": "$.type", "created_at": "$.created_at",
    "actor": "$.actor", "actor_id": "$.actor.id", "actor_login": "$.actor.login",
    "actor_display_login": "$.actor.display_login", "actor_url": "$.actor.url",
    "actor_avatar_url": "$.actor.avatar_url",
    "repo": "$.repo", "repo_id": "$.repo.id", "repo_name": "$.repo.name", "repo_url": "$.repo.url",
    "payload": "$.payload", "payload_repository_id": "$.payload.repository_id",
    "payload_push_id": "$.payload.push_id", "payload_ref": "$.payload.ref",
    "payload_head": "$.payload.head", "payload_before": "$.payload.before",
}
CONTAINERS = ("actor", "repo", "payload")
_SCALARS = {  # by the object that holds them: key and name of every field that is no container
    owner: tuple((path.rsplit(".", 1)[1], name) for name, path in ENVELOPE_PATHS.items()
                 if name not in CONTAINERS and path.rsplit(".", 1)[0] == (f"$.{owner}" if owner else "$"))
    for owner in ("", *CONTAINERS)}
# The kind of the envelope and of its containers; kind and text of every other field.
FIELD_NAMES = ("k_document", *[f"k_{name}" for name in CONTAINERS],
               *[f"{part}_{name}" for fields in _SCALARS.values() for _, name in fields for part in "ks"])
ENVELOPE_TYPE = T.StructType([*ELEMENT_TYPE.fields, *[T.StructField(name, T.StringType()) for name in FIELD_NAMES]])
ENVELOPES_TYPE = T.StructType([
    T.StructField("head", ELEMENT_TYPE),
    T.StructField("elements", T.ArrayType(ENVELOPE_TYPE)),
])
PROBLEM_TYPE = T.StructType([T.StructField("is_array", T.BooleanType()), T.StructField("head", ELEMENT_TYPE)])

_ARROW_ELEMENT = pa.struct([
    ("text", pa.string()), ("actor_text", pa.string()), ("repo_text", pa.string()),
    ("undefined", pa.bool_()), ("actor_undefined", pa.bool_()), ("repo_undefined", pa.bool_()),
    ("unstorable", pa.bool_()),
])
_ARROW_DOCUMENT = pa.struct([("head", _ARROW_ELEMENT), ("elements", pa.list_(_ARROW_ELEMENT))])
_ARROW_ENVELOPE = pa.struct([*_ARROW_ELEMENT, *[pa.field(name, pa.string()) for name in FIELD_NAMES]])
_ARROW_ENVELOPES = pa.struct([("head", _ARROW_ELEMENT), ("elements", pa.list_(_ARROW_ENVELOPE))])
_ARROW_PROBLEM = pa.struct([("is_array", pa.bool_()), ("head", _ARROW_ELEMENT)])


# A whole string, what is neither string nor bracket, or a quote that ends nowhere.
_NO_BRACKET = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++|"'


def may_nest_too_deep(body: Column) -> Column:
    """True for every body nested deeper than ``MAX_NESTING``, and for few others.

    One pass leaves the brackets outside strings, a few for each hundred characters. Each
    peeling takes the innermost of them away, one level at most, so a body that is too deep keeps
    an opening bracket for each level not peeled, and its closing one unless it is cut off.
    """
    brackets = F.regexp_replace(body, _NO_BRACKET, "")
    for _ in range(PEELED_LEVELS):
        brackets = F.regexp_replace(brackets, r"\[\]|\{\}", "")
    openings = F.octet_length(body) - F.octet_length(F.replace(F.replace(body, F.lit("[")), F.lit("{")))
    return (openings > MAX_NESTING) & (F.length(brackets) > MAX_NESTING - PEELED_LEVELS)


def needs_exact_decoder(body: Column) -> Column:
    """True when the body holds a token the native printer would change, or may nest too deep.

    Numbers are looked for only outside string values: a cheap test runs first, and the
    strings are blanked out only for bodies that pass it. Plain searches for a backslash or a
    character beyond ASCII spare most bodies the patterns that need one.
    """
    inner = r"[:\[,]\s*-?(?:\d+[.eE]|\d{19})"
    number = r"(?:^|[:\[,])\s*-?(?:\d+[.eE]|\d{19})"
    bare = F.substring(F.ltrim(body, F.lit(" \t\n\x0b\f\r")), 1, 1).rlike("[-0-9]")
    unescaped = F.when(body.contains("\\"), F.regexp_replace(body, r"\\.", "")).otherwise(body)
    skeleton = F.regexp_replace(unescaped, r'"[^"]*"', '""')
    wide_key = r'"[^"]*[\x{10000}-\x{10FFFF}][^"]*"\s*:'
    return F.coalesce(
        F.when(F.length(body) > NATIVE_BODY_LIMIT, True)
        .when(body.contains("\\u") & body.rlike(r"\\u(?:00[01]|[dD][89a-fA-F])"), True)
        .when((bare | body.rlike(inner)) & skeleton.rlike(number), True)
        .when((F.octet_length(body) > F.length(body)) & body.rlike(r"[\x{10000}-\x{10FFFF}]")
              & unescaped.rlike(wide_key), True)
        .when(may_nest_too_deep(body), True),
        F.lit(False),
    )


def _float_text(number: float) -> str:
    shortest = repr(number)
    if "e" not in shortest:
        return shortest
    mantissa, exponent = shortest.split("e")
    if "." not in mantissa:
        mantissa += ".0"
    sign = "-" if exponent.startswith("-") else "+"
    return f"{mantissa}e{sign}{exponent.lstrip('+-').rjust(2, '0')}"


class _Facts:
    """What was met while one value was written."""

    def __init__(self):
        self.undefined = False
        self.unstorable = False


def _write_string(text: str, facts: _Facts) -> str:
    if text.isascii() and "\x00" not in text:
        return encode_basestring(text)
    if "\x00" in text:
        facts.unstorable = True
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        # Half a surrogate pair: no digest can be taken and no text column can hold it.
        facts.undefined = facts.unstorable = True
        text = text.encode("utf-8", "replace").decode("utf-8")
    return encode_basestring(text)


def _write(value, facts: _Facts, depth: int = 0) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return _write_string(value, facts)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if math.isfinite(value):
            return _float_text(value)
        facts.undefined = True
        return "null"
    if depth >= MAX_NESTING:
        raise ValueError("nesting is too deep")
    if isinstance(value, list):
        return "[" + ",".join([_write(item, facts, depth + 1) for item in value]) + "]"
    ordered = sorted(value.items(), key=itemgetter(0))  # code points sort as their UTF-8 does
    return "{" + ",".join(
        [f"{_write_string(key, facts)}:{_write(item, facts, depth + 1)}" for key, item in ordered]) + "}"


def _element(value, depth: int = 0) -> dict:
    facts, actor, repo = _Facts(), _Facts(), _Facts()
    is_object = isinstance(value, dict)
    return {
        "text": _write(value, facts, depth),
        "actor_text": _write(value.get("actor"), actor) if is_object else None,
        "repo_text": _write(value.get("repo"), repo) if is_object else None,
        "undefined": facts.undefined,
        "actor_undefined": actor.undefined,
        "repo_undefined": repo.undefined,
        "unstorable": facts.unstorable,
    }


def _refuse(token: str):
    raise ValueError(f"{token} is not JSON")


def _parse(body: str, parse_float=None):
    if hasattr(sys, "set_int_max_str_digits"):
        sys.set_int_max_str_digits(0)
    return json.loads(body, parse_constant=_refuse, parse_float=parse_float)


# Writes the same text as ``_write`` for values without floats.
_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False)


def _plain_element(item) -> tuple | None:
    """``_element`` of a value without floats, in the order of its fields; None if it needs the slow way."""
    encode, is_object = _ENCODER.encode, isinstance(item, dict)
    actor = repo = None
    if is_object:  # both fragments are written once, for themselves and inside the whole
        actor, repo = encode(item.get("actor")), encode(item.get("repo"))
        text = "{" + ",".join([
            f"{encode(key)}:{actor if key == 'actor' else repo if key == 'repo' else encode(value)}"
            for key, value in sorted(item.items(), key=itemgetter(0))]) + "}"
    else:
        text = encode(item)
    if "\\u0000" in text or text.count("{") + text.count("[") >= MAX_NESTING:
        return None
    if not text.isascii():
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:
            return None
    return text, actor, repo, False, False, False, False


_ABSENT = object()
_KINDS = {str: "string", int: "integer", bool: "boolean", dict: "object", list: "array", type(None): "null", object: "absent"}


def _kind(value) -> str:
    """The JSON kind of a value as its canonical text has it: a number past all doubles is written as null."""
    if type(value) is float:
        return "float" if math.isfinite(value) else "null"
    return _KINDS[type(value)]


def envelope_fields(item) -> list:
    """``FIELD_NAMES`` of one element. Text is given for strings, integers and booleans."""
    is_object = type(item) is dict
    held = [item.get(name, _ABSENT) if is_object else _ABSENT for name in CONTAINERS]
    row = [_kind(item), *map(_kind, held)]
    for owner, fields in zip((item, *held), _SCALARS.values()):
        for key, _ in fields:
            value = owner.get(key, _ABSENT) if type(owner) is dict else _ABSENT
            kind = type(value)
            if kind is str:
                if not value.isascii():
                    try:
                        value.encode("utf-8")
                    except UnicodeEncodeError:
                        value = value.encode("utf-8", "replace").decode("utf-8")
                row += "string", value
            elif kind is int:
                row += "integer", str(value)
            elif kind is bool:
                row += "boolean", "true" if value else "false"
            else:
                row += _kind(value), None
    return row


def decode_array(body: str | None) -> tuple[dict, list[tuple] | None] | None:
    """One body to its canonical texts: its head, and its elements if it is an array; None when it is not JSON."""
    found = _decode_array(body)
    return found and found[:2]


def _decode_array(body: str | None) -> tuple[dict, list[tuple] | None, list | None] | None:
    """``decode_array`` with the values of the elements."""
    if body is None:
        return None
    floats = []

    def noted(token: str) -> float:
        floats.append(token)
        return float(token)

    try:
        value = _parse(body, noted)
        if not isinstance(value, list):
            return _element(value), None, None
        quick = (None if floats else _plain_element(item) for item in value)
        return _element([]), [tuple(_element(item, 1).values()) if plain is None else plain
                              for item, plain in zip(value, quick)], value
    except (ValueError, RecursionError):
        return None


def is_array_body(body: str | None) -> bool:
    """Whether ``decode_array`` finds elements, without writing them."""
    if body is None:
        return False
    try:
        value = _parse(body)
    except (ValueError, RecursionError):
        return False
    if not isinstance(value, list):
        return False
    level = [value]
    for _ in range(MAX_NESTING):
        level = [item for held in level for item in (held.values() if isinstance(held, dict) else held)
                 if isinstance(item, (dict, list))]
        if not level:
            return True
    return False


def decode_body(body: str | None, items_key: str | None = None) -> dict | None:
    """One body to its canonical texts; None when it is absent or not JSON.

    Without ``items_key`` a top-level array is taken apart into elements. With it, the
    array under that key is, and ``head`` keeps the rest of the document.
    """
    if items_key is None:
        found = decode_array(body)
        if found is None or found[1] is None:
            return found and {"head": found[0], "elements": None}
        return {"head": found[0], "elements": [dict(zip(ELEMENT_TYPE.names, e)) for e in found[1]]}
    if body is None:
        return None
    try:
        value = _parse(body)
        if isinstance(value, dict) and isinstance(value.get(items_key), list):
            _write(value, _Facts())
            items = [_element(item) for item in value[items_key]]
            return {"head": _element({**value, items_key: []}), "elements": items}
        return {"head": _element(value), "elements": None}
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(ENVELOPES_TYPE)
def decode_array_bodies(bodies: pa.Array) -> pa.Array:
    heads, offsets, columns = [], [], [[] for _ in _ARROW_ENVELOPE]
    for body in bodies:  # one text at a time is held beside the columns
        head, elements, items = _decode_array(body.as_py()) or (None, None, None)
        heads.append(head)
        offsets.append(None if elements is None else len(columns[0]))
        rows = [(*element, *envelope_fields(item)) for element, item in zip(elements or (), items or ())]
        for column, values in zip(columns, zip(*rows)):
            column.extend(values)
    offsets.append(len(columns[0]))
    values = pa.StructArray.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(columns, _ARROW_ENVELOPE)], fields=list(_ARROW_ENVELOPE))
    return pa.StructArray.from_arrays(
        [pa.array(heads, type=_ARROW_ELEMENT), pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)],
        fields=list(_ARROW_ENVELOPES))


@F.arrow_udf(PROBLEM_TYPE)
def array_problems(bodies: pa.Array) -> pa.Array:
    """Whether a body is one JSON array and, where it is not, its head; elements are not written."""
    rows = []
    for body in bodies:
        text = body.as_py()
        is_array = is_array_body(text)
        rows.append({"is_array": is_array, "head": None if is_array else (decode_array(text) or (None,))[0]})
    return pa.array(rows, type=_ARROW_PROBLEM)


@F.arrow_udf(T.BooleanType())
def are_array_bodies(bodies: pa.Array) -> pa.Array:
    return pa.array([is_array_body(body.as_py()) for body in bodies], type=pa.bool_())


@F.arrow_udf(DOCUMENT_TYPE)
def decode_item_bodies(bodies: pa.Array) -> pa.Array:
    return pa.array([decode_body(body, "items") for body in bodies.to_pylist()], type=_ARROW_DOCUMENT)


@F.arrow_udf(DOCUMENT_TYPE)
def decode_single_bodies(bodies: pa.Array) -> pa.Array:
    rows = []
    for body in bodies.to_pylist():
        decoded = None
        if body is not None:
            try:
                decoded = {"head": _element(_parse(body)), "elements": None}
            except (ValueError, RecursionError):
                decoded = None
        rows.append(decoded)
    return pa.array(rows, type=_ARROW_DOCUMENT)
