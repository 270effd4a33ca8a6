"""Classification of envelopes: push, ignored, quarantined or failed."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.functions.decoder import CONTAINERS, ENVELOPE_PATHS
from feedledger.functions.json_values import class_name, describe, filled_sql, nothing_there
from feedledger.functions.scalars import parse_iso8601

PUSH_EVENT = "PushEvent"
HANDLED_TYPES = (PUSH_EVENT,)

# Quarantine codes in order of precedence, each with its coarse group.
TAXONOMY = {
    "invalid_envelope": "invalid_envelope",
    "missing_event_type": "invalid_envelope",
    "missing_event_id": "invalid_envelope",
    "invalid_actor_reference": "invalid_envelope",
    "invalid_repository_reference": "invalid_envelope",
    "invalid_occurred_at": "invalid_envelope",
    "missing_required_field": "missing_required_field",
    "invalid_field_format": "missing_required_field",
    "repository_id_mismatch": "integrity_failure",
    "identifier_out_of_range": "missing_required_field",
}
PRECEDENCE = tuple(TAXONOMY)
REQUIRED_PAYLOAD_FIELDS = ("repository_id", "push_id", "ref", "head", "before")

# 40 or 64 hexadecimal digits and nothing else.
SHA_PATTERN = r"^(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\z"

_IDENTIFIERS = ("actor_id", "repo_id", "payload_repository_id", "payload_push_id")
_STRINGS = ("actor_login", "actor_display_login", "actor_url", "actor_avatar_url", "repo_name", "repo_url",
            "payload_ref")
_SHAS = ("payload_head", "payload_before")

ARRIVAL_COLUMNS = ("run_id", "page_no", "received_at", "pos")


def handled_types(requested: str | Iterable[str] = HANDLED_TYPES) -> tuple[str, ...]:
    """The list of event types to process, cleaned; an unknown or empty list is refused."""
    names = [requested] if isinstance(requested, str) else list(requested)
    cleaned = [name for name in (str(n).strip() for n in names) if name]
    if not cleaned:
        raise ValueError("name at least one event type")
    unknown = sorted(set(cleaned) - set(HANDLED_TYPES))
    if unknown:
        raise ValueError(f"unknown event types {', '.join(unknown)}; known are {', '.join(sorted(HANDLED_TYPES))}")
    return tuple(dict.fromkeys(cleaned))


def taxonomy_group(code: Column) -> Column:
    pairs = [F.lit(text) for pair in TAXONOMY.items() for text in pair]
    return F.create_map(*pairs)[code]


def sha_ok(text: Column) -> Column:
    return F.coalesce(text.rlike(SHA_PATTERN), F.lit(False))


def short_name(full_name: Column) -> Column:
    """Last non-empty segment of ``owner/name``; null when there is no slash."""
    trimmed = F.regexp_replace(full_name, r"/+\z", "")
    return F.when(full_name.contains("/") & (trimmed != ""), F.substring_index(trimmed, "/", -1))


def owner_of(full_name: Column) -> Column:
    return F.when(full_name.contains("/"), F.substring_index(full_name, "/", 1))


def payload_fingerprint(text: Column, undefined: Column | None = None) -> Column:
    """SHA-256 of canonical text; null where no digest is defined."""
    digest = F.sha2(text, 256)
    return digest if undefined is None else F.when(~undefined, digest)


def _kind(name: str) -> Column:
    return F.col(f"k_{name}")


def _text(name: str) -> Column:
    return F.col(f"s_{name}")


def read_fields(envelopes: DataFrame) -> DataFrame:
    """Every path the rules look at, with the canonical texts of the envelope and its fragments.

    The decoder gives the kinds, and the texts of strings, integers and booleans. What else stands in
    a field is shown as it is written in the canonical text.
    """
    texts = {f"s_{name}": f"CASE WHEN k_{name} IN ('float', 'object', 'array') THEN get_json_object(text, '{path}') "
                          f"ELSE s_{name} END AS s_{name}"
             for name, path in ENVELOPE_PATHS.items() if name not in CONTAINERS}
    return envelopes.selectExpr(*[texts.get(c, f"`{c}`") for c in envelopes.columns],
                                "text AS canonical_text", "actor_text AS actor_fragment", "repo_text AS repo_fragment")


def normalize(fields: DataFrame) -> DataFrame:
    """Usable values per field, as ``n_`` columns; null where the field cannot be used.

    An id may be an integer or a filled string; identifiers must fit 64 bits.
    """
    return fields.select(
        "*",
        F.expr(f"CASE WHEN k_id = 'integer' OR {filled_sql('id')} THEN s_id END AS n_event_id"),
        F.expr(f"CASE WHEN {filled_sql('type')} THEN s_type END AS n_type"),
        *[F.expr(f"CASE WHEN k_{n} = 'integer' THEN try_cast(s_{n} AS BIGINT) END AS n_{n}") for n in _IDENTIFIERS],
        *[F.expr(f"CASE WHEN {filled_sql(n)} THEN s_{n} END AS n_{n}") for n in _STRINGS],
        *[F.when((_kind(n) == "string") & sha_ok(_text(n)), _text(n)).alias(f"n_{n}") for n in _SHAS],
        F.when(_kind("created_at") == "string", parse_iso8601(_text("created_at"))).alias("n_occurred_at"),
    )


@dataclass(frozen=True)
class Rule:
    """One check of a push, in SQL text: when it is broken, its code and its message.

    The message is ``prefix``, then ``text`` (shown as a value of its JSON kind, or as it
    stands where ``kind`` is null), then ``suffix``.
    """

    code: str
    broken: str
    prefix: str
    kind: str
    text: str
    suffix: str = ""

    def parts(self) -> str:
        return (f"named_struct('broken', coalesce({self.broken}, false), 'rank', {PRECEDENCE.index(self.code)}, "
                f"'code', '{self.code}', 'prefix', '{self.prefix}', 'kind', {self.kind}, "
                f"'text', {self.text}, 'suffix', '{self.suffix}')")


PARTS_SQL = "struct<broken:boolean,rank:int,code:string,prefix:string,kind:string,text:string,suffix:string>"
_NOTHING = "CAST(NULL AS STRING)"


def push_rules() -> list[Rule]:
    """Every check of a push, in check order."""
    actor, repo, payload = ("k_actor = 'object'", "k_repo = 'object'", "k_payload = 'object'")
    gone = {field: f"k_payload_{field} IN ('absent', 'null')" for field in REQUIRED_PAYLOAD_FIELDS}
    not_hex = ", not 40 or 64 hexadecimal characters"

    def shown(name: str, code: str, broken: str, label: str, suffix: str = "") -> Rule:
        text = _NOTHING if name in CONTAINERS else f"s_{name}"
        return Rule(code, broken, f"{label} is ", f"k_{name}", text, suffix)

    def out_of_range(name: str, owner: str, label: str) -> Rule:
        return Rule("identifier_out_of_range", f"{owner} AND k_{name} = 'integer' AND n_{name} IS NULL",
                    f"{label} ", _NOTHING, f"s_{name}", " exceeds a 64-bit identifier")

    def payload_field(field: str, suffix: str = "") -> Rule:
        name = f"payload_{field}"
        unusable = f"k_{name} <> 'integer'" if field.endswith("_id") else f"n_{name} IS NULL"
        return shown(name, "invalid_field_format", f"{payload} AND NOT {gone[field]} AND {unusable}",
                     f"payload.{field}", suffix)

    absent = ", ".join(f"CASE WHEN {flag} THEN '{field}' END" for field, flag in gone.items())
    bad_actor, bad_repo = "invalid_actor_reference", "invalid_repository_reference"
    return [
        shown("id", "missing_event_id", "n_event_id IS NULL", "id"),
        shown("actor", bad_actor, f"NOT {actor}", "actor"),
        shown("actor_id", bad_actor, f"{actor} AND k_actor_id <> 'integer'", "actor.id"),
        out_of_range("actor_id", actor, "actor.id"),
        shown("actor_login", bad_actor, f"{actor} AND n_actor_login IS NULL", "actor.login"),
        shown("repo", bad_repo, f"NOT {repo}", "repo"),
        shown("repo_id", bad_repo, f"{repo} AND k_repo_id <> 'integer'", "repo.id"),
        out_of_range("repo_id", repo, "repo.id"),
        shown("repo_name", bad_repo, f"{repo} AND n_repo_name IS NULL", "repo.name"),
        shown("created_at", "invalid_occurred_at", "n_occurred_at IS NULL", "created_at"),
        shown("payload", "missing_required_field", f"NOT {payload}", "payload"),
        Rule("missing_required_field", f"{payload} AND ({' OR '.join(gone.values())})", "payload is missing ",
             _NOTHING, f"concat_ws(', ', {absent})"),
        payload_field("repository_id"),
        out_of_range("payload_repository_id", payload, "payload.repository_id"),
        payload_field("push_id"),
        out_of_range("payload_push_id", payload, "payload.push_id"),
        payload_field("ref"), payload_field("head", not_hex), payload_field("before", not_hex),
        # Compared only when both sides are usable; a repository without a name is not.
        Rule("repository_id_mismatch",
             f"{payload} AND n_repo_name IS NOT NULL AND n_payload_repository_id <> n_repo_id",
             "payload.repository_id ", _NOTHING,
             "concat(n_payload_repository_id, ' does not match repo.id ', n_repo_id)"),
    ]


def check(normalized: DataFrame) -> DataFrame:
    """Adds ``broken``, the rules a push breaks in check order, with the parts of their messages.

    ``first_code`` is the broken rule's code that comes first in precedence. Message text is put
    together later, for the few rules that are broken, by one lambda. The parts are only gathered
    for a push that breaks any, and ``first_code`` needs none: Spark interprets a lambda and all
    that is inlined into it row by row.
    """
    rules = push_rules()
    tested = ", ".join(rule.parts() for rule in rules)
    any_broken = " OR ".join(f"coalesce({rule.broken}, false)" for rule in rules)
    none = f"CAST(array() AS array<{PARTS_SQL}>)"
    codes = " ".join(f"WHEN {rule.broken} THEN '{rule.code}'"
                     for rule in sorted(rules, key=lambda rule: PRECEDENCE.index(rule.code)))
    return normalized.withColumns({
        "broken": F.expr(
            f"CASE WHEN route = 'process' THEN CASE WHEN {any_broken} THEN filter(array({tested}), rule -> rule.broken) "
            f"ELSE {none} END END"),
        "first_code": F.expr(f"CASE WHEN route = 'process' THEN CASE {codes} END END")})


def push_code() -> Column:
    """The broken rule's code that comes first in precedence; null when none is broken."""
    return F.col("first_code")


def violations() -> Column:
    """All broken rules of a checked push as (code, message), in check order."""
    return F.transform("broken", lambda rule: F.struct(
        rule["code"].alias("code"),
        F.concat(rule["prefix"], F.when(rule["kind"].isNull(), rule["text"]).otherwise(
            describe(rule["kind"], rule["text"], rule["text"])), rule["suffix"]).alias("message")))


def push_message() -> Column:
    return F.array_join(F.transform(violations(), lambda v: v["message"]), "; ")


def route(types: Iterable[str]) -> Column:
    """Where an envelope goes before any push rule is looked at."""
    return (
        F.when(_kind("document") != "object", F.lit("invalid_envelope"))
        .when(F.col("n_type").isNull(), F.lit("missing_event_type"))
        .when(~F.col("n_type").isin(*types), F.lit("ignored"))
        .otherwise(F.lit("process"))
    )


def checked_envelopes(envelopes: DataFrame, types: str | Iterable[str] = HANDLED_TYPES) -> DataFrame:
    """Fields, usable values, route and broken rules of every envelope: ``classify`` before its verdict."""
    routed = normalize(read_fields(envelopes)).withColumn("route", route(handled_types(types)))
    return check(routed)


def classify(envelopes: DataFrame, types: str | Iterable[str] = HANDLED_TYPES) -> DataFrame:
    """One verdict per envelope.

    ``outcome`` is push_event, ignored, quarantined or failed; a push carries ``push``,
    ``actor`` and ``repository`` structs, a quarantined one its code, message and digest.
    ``fragment_undefined`` marks a push that cannot be evidenced and so cannot be created.
    Stage the result before filtering it: a filter on ``outcome`` would be pushed below the
    rules and evaluate all of them a second time.
    """
    routed = checked_envelopes(envelopes, types)
    refused = F.when(F.col("route") == "process", push_code()) \
        .when(F.col("route") != "ignored", F.col("route"))
    judged = routed.withColumn("error_code", refused)
    stored = F.col("route") != "ignored"
    fails = stored & (F.col("unstorable") | (F.col("error_code").isNotNull() & F.col("undefined")))
    judged = judged.withColumn("outcome", (
        F.when(~stored, "ignored").when(fails, "failed")
        .when(F.col("error_code").isNotNull(), "quarantined").otherwise("push_event")))
    is_push, quarantined = F.col("outcome") == "push_event", F.col("outcome") == "quarantined"
    no_type = F.col("route").isin("invalid_envelope", "missing_event_type")
    message = (
        F.when(F.col("route") == "process", push_message())
        .when(F.col("route") == "invalid_envelope", F.concat(
            F.lit("event is "), class_name(_kind("document"), F.col("canonical_text")),
            F.lit(", not a JSON object")))
        .when(F.col("route") == "missing_event_type", F.concat(F.lit("type is "), F.when(
            nothing_there(_kind("type")), F.lit("absent")).otherwise(
            class_name(_kind("type"), _text("type")))))
    )
    return judged.select(
        *[c for c in envelopes.columns if c in ARRIVAL_COLUMNS or c in ("source_id", "batch_id")],
        "outcome",
        F.coalesce(F.col("n_type") == PUSH_EVENT, F.lit(False)).alias("push_typed"),
        F.when(~no_type, F.col("n_type")).alias("event_type"),
        F.when(_kind("document") == "object", F.col("n_event_id")).alias("github_event_id"),
        F.when(is_push, F.struct(
            F.col("n_payload_push_id").alias("github_push_id"), F.col("n_repo_id").alias("github_repository_id"),
            F.col("n_actor_id").alias("github_actor_id"), F.col("n_payload_ref").alias("ref"),
            F.col("n_payload_head").alias("head_sha"), F.col("n_payload_before").alias("before_sha"),
            F.col("n_occurred_at").alias("occurred_at"))).alias("push"),
        F.when(is_push, F.struct(
            F.col("n_actor_id").alias("github_id"), F.col("n_actor_login").alias("login"),
            F.col("n_actor_display_login").alias("display_login"), F.col("n_actor_url").alias("api_url"),
            F.col("n_actor_avatar_url").alias("avatar_url"))).alias("actor"),
        F.when(is_push, F.struct(
            F.col("n_repo_id").alias("github_id"), F.col("n_repo_name").alias("full_name"),
            short_name(F.col("n_repo_name")).alias("name"), owner_of(F.col("n_repo_name")).alias("owner_login"),
            F.col("n_repo_url").alias("api_url"))).alias("repository"),
        F.when(quarantined, F.col("error_code")).alias("error_code"),
        F.when(quarantined, message).alias("error_message"),
        F.when(quarantined, payload_fingerprint(F.col("canonical_text"), F.col("undefined")))
        .alias("payload_fingerprint"),
        F.when(is_push | (quarantined & (_kind("document") != "null")), F.col("canonical_text")).alias("raw_payload"),
        F.when(is_push, F.col("actor_fragment")).alias("actor_fragment"),
        F.when(is_push, F.col("repo_fragment")).alias("repo_fragment"),
        (is_push & (F.col("actor_undefined") | F.col("repo_undefined"))).alias("fragment_undefined"),
    )
