"""Opaque positions for keyset paging."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedledger.functions.scalars import iso8601_micros, parse_iso8601

# Bounds of what a position may name.
MAX_YEAR = 294_276


def encode_cursor(occurred_at: Column, seq: Column) -> Column:
    """URL-safe base64, without padding, of ``instant|sequence``."""
    text = F.concat(iso8601_micros(occurred_at), F.lit("|"), seq.cast("string"))
    encoded = F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")
    return F.regexp_replace(encoded, r"[=\r\n]", "")


def decode_cursor(text: Column) -> Column:
    """``struct(occurred_at, seq)``, or null for anything encode_cursor cannot have made."""
    clean = F.when(text.rlike(r"^[A-Za-z0-9_-]+={0,2}\z"),
                   F.translate(F.regexp_replace(text, "=", ""), "-_", "+/"))
    padded = F.rpad(clean, (F.ceil(F.length(clean) / 4) * 4).cast("int"), F.lit("="))
    plain = F.try_to_binary(padded, F.lit("base64")).cast("string")
    instant = parse_iso8601(F.substring_index(plain, "|", 1))
    tail = F.regexp_extract(plain, r"^[^|]*\|(\d+)\z", 1)
    seq = tail.try_cast("long")
    legal = instant.isNotNull() & seq.isNotNull() & F.year(instant).between(0, MAX_YEAR)
    return F.when(legal, F.struct(instant.alias("occurred_at"), seq.alias("seq")))
