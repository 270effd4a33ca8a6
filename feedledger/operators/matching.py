"""Matching returned documents to what was asked for, and judging them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.functions.json_values import filled_sql, with_fields
from feedledger.functions.scalars import casefold_ascii, parse_iso8601
from feedledger.operators.evidence import observation_id
from feedledger.schemas import OBSERVATIONS

# Outcomes of judging one returned document.
APPLIED = "applied"
INVALID_FIELD = "invalid_contract_field"


# Paths of a document each class is judged by.
DOCUMENT_PATHS = {
    "actor": {"id": "$.id", "name": "$.login", "type": "$.type"},
    "repository": {
        "id": "$.id", "name": "$.full_name", "owner": "$.owner", "owner_id": "$.owner.id",
        "owner_login": "$.owner.login", "fork": "$.fork", "archived": "$.archived",
        "default_branch": "$.default_branch", "description": "$.description", "language": "$.language",
        "created_at": "$.created_at"},
}


def exploded_items(documents: DataFrame) -> DataFrame:
    """One row per returned item of a well-formed search document, as text."""
    usable = documents.where("document_error IS NULL")
    items = F.slice("items", 1, 2**31 - 1)
    return (usable.select("request_batch_id", "received_at", F.posexplode(items).alias("pos", "_item"))
            .select("request_batch_id", "received_at", "pos", "_item.text", "_item.exact"))


def _parsed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({"_value": F.try_parse_json(F.col(text)),
                           "_exact_text": F.when(F.col("exact"), F.col(text))})


def read_documents(kind: str, df: DataFrame, text: str) -> DataFrame:
    """Adds the kinds and values of the judged paths of the document in column ``text``."""
    return with_fields(_parsed(df, text), DOCUMENT_PATHS[kind], ("owner",), "_value", "_exact_text", keep=df.columns)


def item_keys(kind: str, items: DataFrame) -> DataFrame:
    """Items with what they can be matched by: ``item_id`` and ``item_key``."""
    paths = {name: DOCUMENT_PATHS[kind][name] for name in ("id", "name")}
    read = with_fields(_parsed(items, "text"), paths, (), "_value", "_exact_text", keep=items.columns)
    return read.select(
        *items.columns,
        F.expr("CASE WHEN k_id = 'integer' THEN try_cast(s_id AS BIGINT) END AS item_id"),
        casefold_ascii(F.col("s_name")).alias("item_key"))


def match_items(kind: str, leases: DataFrame, items: DataFrame) -> DataFrame:
    """Leases with the item each one gets: by id first, else by name, else missing.

    Only keys and positions meet in the matching joins; the item itself is fetched by its
    position at the end.
    """
    keyed = item_keys(kind, items)
    by_id = (keyed.where("item_id IS NOT NULL").groupBy("request_batch_id", F.col("item_id").alias("github_id"))
             .agg(F.min("pos").alias("_by_id")))
    by_name = (keyed.where("item_key IS NOT NULL").groupBy("request_batch_id", F.col("item_key").alias("_key"))
               .agg(F.min("pos").alias("_by_name")))
    found = (leases.withColumn("_key", casefold_ascii(F.col("identifier")))
             .join(by_id, ["request_batch_id", "github_id"], "left")
             .join(by_name, ["request_batch_id", "_key"], "left")
             .withColumn("pos", F.coalesce("_by_id", "_by_name"))
             .withColumn("matched_by", F.when(F.col("_by_id").isNotNull(), "id")
                         .when(F.col("_by_name").isNotNull(), "identifier").otherwise("missing"))
             .drop("_key", "_by_id", "_by_name"))
    fetched = items.select("request_batch_id", "pos", "text", "exact")
    return found.join(fetched, ["request_batch_id", "pos"], "left")


def unrequested_items(items: DataFrame, matched: DataFrame) -> DataFrame:
    used = matched.where("pos IS NOT NULL").select("request_batch_id", "pos")
    return items.join(used, ["request_batch_id", "pos"], "left_anti")


def contract_error(kind: str) -> Column:
    """The first contract rule a read document breaks, as its message; null when it holds."""
    if kind == "actor":
        return F.expr(f"CASE WHEN NOT {filled_sql('type')} THEN 'type is not a non-empty string' END")
    rules = {
        "owner.id must be an integer": "k_owner <> 'object' OR k_owner_id <> 'integer'",
        "fork must be boolean": "k_fork <> 'boolean'",
        "archived must be boolean": "k_archived <> 'boolean'",
        "default_branch is not a non-empty string": f"NOT {filled_sql('default_branch')}",
        "description must be a string or null": "k_description NOT IN ('string', 'null', 'absent')",
        "language must be a string or null": "k_language NOT IN ('string', 'null', 'absent')",
        "created_at must be ISO-8601": "k_created_at <> 'string' OR n_created_at IS NULL",
    }
    return F.expr("CASE " + " ".join(f"WHEN {test} THEN '{message}'" for message, test in rules.items()) + " END")


def contract_columns(kind: str) -> Column:
    """The columns a read document gives its entity."""
    if kind == "actor":
        return F.struct(F.col("s_type").alias("account_type"))
    filled = {n: F.expr(f"CASE WHEN {filled_sql(n)} THEN s_{n} END") for n in ("description", "language", "owner_login")}
    return F.struct(
        filled["description"].alias("description"), filled["language"].alias("language"),
        F.col("s_owner_id").try_cast("long").alias("owner_github_id"), filled["owner_login"].alias("owner_login"),
        F.col("s_fork").try_cast("boolean").alias("fork"), F.col("s_archived").try_cast("boolean").alias("archived"),
        F.col("s_default_branch").alias("default_branch"), F.col("n_created_at").alias("github_created_at"))


def judge_documents(kind: str, df: DataFrame, text: str) -> DataFrame:
    """Documents in column ``text`` judged for ``github_id``: adds ``identity_error``,
    ``contract_error``, ``returned_id``, ``returned_name`` and ``attributes``."""
    read = read_documents(kind, df, text)
    if kind == "repository":
        read = read.withColumn("n_created_at", F.when(
            F.col("k_created_at") == "string", parse_iso8601(F.col("s_created_at"))))
    identity = (F.when(F.col("k_id") != "integer", "missing_identity")
                .when(F.coalesce(F.col("s_id").try_cast("long") != F.col("github_id"), F.lit(True)), "identity_mismatch"))
    judged = read.select(
        *df.columns, identity.alias("identity_error"), contract_error(kind).alias("contract_error"),
        F.col("s_id").alias("returned_id"), F.col("k_id").alias("returned_id_kind"),
        F.col("s_name").alias("returned_name"), contract_columns(kind).alias("attributes"))
    sound = F.col("identity_error").isNull() & F.col("contract_error").isNull()
    return judged.withColumn("attributes", F.when(sound, F.col("attributes")))


def validate_items(kind: str, matched: DataFrame) -> DataFrame:
    """Adds ``validation_outcome`` (null when nothing was returned) and ``attributes``."""
    judged = judge_documents(kind, matched, "text")
    same = F.col("returned_id_kind").isin("integer", "float") & F.coalesce(
        F.col("returned_id").try_cast("decimal(38,4)") == F.col("github_id"), F.lit(False))
    outcome = F.when(~same, "identity_mismatch")
    if kind == "repository":
        renamed = casefold_ascii(F.coalesce("returned_name", F.lit(""))) != casefold_ascii(
            F.coalesce("identifier", F.lit("")))
        outcome = outcome.when(renamed, "renamed_repository")
    outcome = (outcome.when(F.col("identity_error").isNotNull(), F.col("identity_error"))
               .when(F.col("contract_error").isNotNull(), INVALID_FIELD).otherwise(APPLIED))
    return (judged.withColumn("validation_outcome", F.when(F.col("pos").isNotNull(), outcome))
            .withColumn("attributes", F.when(F.col("validation_outcome") == APPLIED, F.col("attributes")))
            .withColumnRenamed("text", "item_text")
            .drop("exact", "identity_error", "contract_error", "returned_id", "returned_id_kind", "returned_name"))


def validate_details(kind: str, documents: DataFrame) -> DataFrame:
    """Detail documents joined to their lease: adds ``validation_outcome``, ``document_message``
    and ``attributes``."""
    judged = judge_documents(kind, documents, "kept_payload")
    outcome = F.coalesce("error_code", "identity_error", F.when(F.col("contract_error").isNotNull(), INVALID_FIELD),
                         F.lit(APPLIED))
    message = (
        F.when(F.col("error_code").isNotNull(), F.col("error_message"))
        .when(F.col("identity_error") == "missing_identity", "document carries no integer id")
        .when(F.col("identity_error") == "identity_mismatch", F.concat(
            F.lit("document identifies "), F.col("returned_id"), F.lit(", expected "),
            F.col("github_id").cast("string")))
        .otherwise(F.col("contract_error")))
    return (judged.withColumn("validation_outcome", outcome).withColumn("document_message", message)
            .withColumn("attributes", F.when(F.col("validation_outcome") == APPLIED, F.col("attributes")))
            .drop("identity_error", "contract_error", "returned_id", "returned_id_kind", "returned_name", "exact"))


def _observation_rows(df: DataFrame, kind: str, source: str, key: list[Column], entity: Column,
                      payload: Column, identifier: Column, now: Column) -> DataFrame:
    return df.select(
        observation_id(F.lit(source), *key).alias("observation_id"),
        F.lit(kind).alias("entity_kind"), entity.cast("long").alias("entity_github_id"),
        F.lit(source).alias("source"), now.alias("observed_at"), payload.alias("raw_payload"),
        F.sha2(payload, 256).alias("payload_fingerprint"),
        F.lit(None).cast("string").alias("github_event_id"), "request_batch_id",
        identifier.cast("string").alias("requested_identifier"), "validation_outcome",
        now.alias("created_at"), now.alias("updated_at")).select(*OBSERVATIONS.names)


def search_observation_id(github_id: Column) -> Column:
    return observation_id(F.lit("search"), F.col("request_batch_id"), github_id)


def record_observations(kind: str, validated: DataFrame, extras: DataFrame, now: Column) -> DataFrame:
    """Evidence of one answered batch: every matched item, and every item nobody asked for."""
    matched = _observation_rows(
        validated.where("pos IS NOT NULL"), kind, "search",
        [F.col("request_batch_id"), F.col("github_id")], F.col("github_id"), F.col("item_text"),
        F.col("identifier"), now)
    named = item_keys(kind, extras).withColumn("validation_outcome", F.lit("unrequested_result"))
    unasked = _observation_rows(
        named, kind, "search", [F.col("request_batch_id"), F.lit("unrequested"), F.col("pos")],
        F.col("item_id"), F.col("text"), F.lit(None), now)
    return matched.unionByName(unasked)


def record_detail_observations(kind: str, validated: DataFrame, now: Column) -> DataFrame:
    return _observation_rows(
        validated, kind, "detail", [F.col("request_batch_id"), F.col("github_id")], F.col("github_id"),
        F.col("kept_payload"), F.col("identifier"), now)
