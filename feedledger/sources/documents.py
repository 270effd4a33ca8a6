"""Landed answers to lookups: search documents and detail documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from feedledger.functions.http import http_class
from feedledger.functions.json_values import class_name, json_type, kind_of_shape
from feedledger.functions.scalars import is_blank
from feedledger.sources.json_bodies import with_elements

# ``error_kind`` and ``error_message`` are set when no answer arrived at all.
ANSWER_LOG = T.StructType([
    T.StructField("request_batch_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.StringType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("error_message", T.StringType()),
])

# Classes of an exchange that brought no answer, or a refusal to answer now.
DEFERRED_CLASSES = ("budget_denied", "gate_unavailable", "rate_limited", "secondary_limited")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER_LOG).json(path)


def answer_class() -> Column:
    return F.coalesce(F.col("error_kind"), http_class(F.col("status"), F.col("headers")))


def search_documents(answers: DataFrame) -> DataFrame:
    """Answers to batched lookups with ``total_count``, ``incomplete_results``, ``items`` and
    ``document_error`` (null for a well-formed document)."""
    head = F.col("parsed.head")
    read = with_elements(answers, items="items").select(
        *answers.columns, F.col("parsed.elements").alias("items"), head.isNull().alias("_unreadable"),
        head["text"].alias("_text"), F.schema_of_variant(head["value"]).alias("_shape"),
        F.try_variant_get(head["value"], "$.total_count", "variant").alias("_total"),
        F.try_variant_get(head["value"], "$.incomplete_results", "variant").alias("_incomplete"))
    # Items are kept as text: what is stored and sent round stays plain, and an item is
    # parsed again only where it is judged.
    read = read.withColumn("items", F.transform("items", lambda e: F.struct(
        F.coalesce(e["text"], F.to_json(e["value"])).alias("text"), e["text"].isNotNull().alias("exact"),
        e["undefined"].alias("undefined"), e["unstorable"].alias("unstorable"))))
    shaped = read.withColumns({
        "_total_kind": json_type(F.col("_total"), F.get_json_object("_text", "$.total_count")),
        "_incomplete_kind": json_type(F.col("_incomplete"), F.lit(None).cast("string"))})
    total_ok, incomplete_ok = F.col("_total_kind") == "integer", F.col("_incomplete_kind") == "boolean"
    error = (
        F.when(F.col("_unreadable"), "response body is not valid JSON")
        .when(~F.col("_shape").startswith("OBJECT"), "Search response is not an object")
        .when(F.col("items").isNull(), "Search response items is not an array")
        .when(~total_ok | ~incomplete_ok, "Search response metadata is malformed")
    )
    return shaped.select(
        *answers.columns, F.when(total_ok, F.try_variant_get("_total", "$", "bigint")).alias("total_count"),
        F.when(incomplete_ok, F.try_variant_get("_incomplete", "$", "boolean")).alias("incomplete_results"),
        "items", error.alias("document_error"))


def read_search_documents(spark: SparkSession, path: str) -> DataFrame:
    return search_documents(read_answers(spark, path))


def detail_documents(answers: DataFrame) -> DataFrame:
    """Answers to single lookups: ``kept_payload`` is the document as evidence keeps it, with
    ``error_code`` and ``error_message`` when the body is no JSON object;
    ``transport_message`` is the error of an exchange that brought no answer."""
    head = F.col("parsed.head")
    read = with_elements(answers, items="").select(
        *answers.columns, head.alias("document"), F.schema_of_variant(head["value"]).alias("_shape"),
        F.coalesce(head["text"], F.to_json(head["value"])).alias("_text"))
    text = F.col("_text")
    kind = kind_of_shape(F.col("_shape"), text)
    unreadable = F.col("document").isNull()
    code = (F.when(is_blank(F.col("body")) | unreadable, "unparsable_document")
            .when(kind != "object", "not_an_object"))
    message = (
        F.when(is_blank(F.col("body")), "response body was empty")
        .when(unreadable, "response body is not valid JSON")
        .when(kind != "object", F.concat(F.lit("expected a JSON object, got "), class_name(kind, text)))
    )
    unparsed = F.to_json(F.struct(F.coalesce("body", F.lit("")).alias("unparsed_body")))
    kept = [c for c in answers.columns if c != "error_message"]
    return read.select(*kept, F.col("error_message").alias("transport_message"),
                       code.alias("error_code"), message.alias("error_message"), F.coalesce(text, unparsed).alias("kept_payload"),
                       F.col("document.text").isNotNull().alias("exact"))


def read_detail_documents(spark: SparkSession, path: str) -> DataFrame:
    return detail_documents(read_answers(spark, path))
