"""A bit table of fixed size that lets tasks skip rows whose key is surely not wanted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from feedledger.llm.worker import ship

ship(__name__)

BITS = 1 << 23


def sieve(keys: DataFrame, column: str) -> np.ndarray:
    """Bits set for the 64-bit numbers in ``column``: 1 MB, whatever the number of keys.

    It only saves work: what passes is joined with the keys afterwards, so a table too full
    to help changes no result.
    """
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words = (keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(({column} & 63L) as int))").alias("bits"))
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    table = np.zeros(BITS >> 6, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` may be wanted."""
    at = keys.view(np.uint64) & np.uint64(BITS - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
