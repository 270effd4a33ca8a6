"""Bodies of JSON text to typed elements, natively where that is exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.functions.decoder import (
    are_array_bodies, array_problems, decode_item_bodies, decode_single_bodies, needs_exact_decoder,
)

ELEMENT_SQL = (
    "struct<value:variant,text:string,actor_text:string,repo_text:string,undefined:boolean,"
    "actor_undefined:boolean,repo_undefined:boolean,unstorable:boolean>"
)


def _wrapped(body: Column) -> Column:
    # The variant parser stops at the end of the first value. Framing the body with its own
    # hash proves that the value it read is the whole body and nothing follows it.
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit(","), F.xxhash64(body).cast("string"), F.lit("]")))


def with_frame(df: DataFrame, body: str) -> DataFrame:
    """Adds ``_framed``, the body inside its frame, and ``_whole``: whether it is one JSON value and nothing else."""
    return df.withColumn("_framed", _wrapped(F.col(body))).withColumn("_whole", F.coalesce(
        F.try_variant_get("_framed", "$[1]", "bigint") == F.xxhash64(body), F.lit(False)))


def _decoded_element(x: Column) -> Column:
    return F.struct(F.try_parse_json(x["text"]).alias("value"), *[
        x[name].alias(name) for name in (
            "text", "actor_text", "repo_text", "undefined", "actor_undefined",
            "repo_undefined", "unstorable")])


def _native_element(v: Column) -> Column:
    absent, no = F.lit(None).cast("string"), F.lit(False)
    return F.struct(v.alias("value"), absent.alias("text"), absent.alias("actor_text"),
                    absent.alias("repo_text"), no.alias("undefined"),
                    no.alias("actor_undefined"), no.alias("repo_undefined"),
                    no.alias("unstorable"))


def with_elements(df: DataFrame, body: str = "body", items: str = "items") -> DataFrame:
    """Adds ``parsed``: its ``elements`` (array of element structs, null when there is no such
    array) and ``head`` (an element struct for the document itself, null when it is not JSON).

    ``"items"`` reads the array under that key, and ``""`` the document as one value. All bodies
    are read in one pass; those alone take the decoder that the native parser cannot print exactly.
    """
    decode = {"items": decode_item_bodies, "": decode_single_bodies}[items]
    routed = df.withColumn("_exact", needs_exact_decoder(F.col(body)))
    routed = with_frame(routed.withColumn("_fast", F.when(~F.col("_exact"), F.col(body))), "_fast")
    routed = routed.withColumn("_decoded", decode(F.when(F.col("_exact"), F.col(body))))
    framed = F.col("_framed")
    # Taken straight out of the frame: every step between would write the whole body anew.
    if items == "":
        native_array = F.lit(None).cast("array<variant>")
    else:
        native_array = F.when(F.col("_whole"), F.try_variant_get(framed, "$[0].items", "array<variant>"))
    elements = F.when(F.col("_exact"), F.transform(F.col("_decoded.elements"), _decoded_element)) \
        .otherwise(F.transform(native_array, _native_element))
    head = F.when(F.col("_exact") & F.col("_decoded").isNotNull(), _decoded_element(F.col("_decoded.head"))) \
        .when(F.col("_whole"), _native_element(F.try_variant_get(framed, "$[0]", "variant")))
    return _with_parsed(routed, elements, head).drop("_exact", "_fast", "_framed", "_whole", "_decoded")


def _with_parsed(df: DataFrame, elements: Column, head: Column) -> DataFrame:
    return df.withColumn("parsed", F.struct(
        elements.cast(f"array<{ELEMENT_SQL}>").alias("elements"), head.cast(ELEMENT_SQL).alias("head")))


def with_problem(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``is_array``, as ``with_array_flag`` does, and ``head``, an element struct of a document that is
    no array; null when it is not JSON."""
    read = df.withColumn("_problem", array_problems(F.col(body)))
    head = F.when(F.col("_problem.head").isNotNull(), _decoded_element(F.col("_problem.head")))
    return read.withColumns({"is_array": F.col("_problem.is_array"), "head": head}).drop("_problem")


def with_array_flag(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``is_array``: whether ``explode_envelopes`` finds the body to be one JSON array, by the same parser."""
    return df.withColumn("is_array", are_array_bodies(F.col(body)))
