"""Joins of rows with one small row per key, where one key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key with more than one row in so many is hot; there can be no more hot keys than that.
HOT_SHARE = 1000


def join_by_source(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``per_key``, which holds every key once and its rows in ``count``.

    A hot key's rows stay where they are: keys with more than a thousandth of all rows are at
    most a thousand, and only these are broadcast. The rows of the others are shuffled by key,
    none of which can then fill more than a thousandth of the work. Keys must not be null.
    ``rows`` is read twice, so it should be a written table. ``count`` is dropped.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot_row = F.col(count) > total / HOT_SHARE
    hot = F.broadcast(per_key.where(hot_row).drop(count))
    if per_key.where(~hot_row).isEmpty():
        return rows.join(hot, keys)
    cold = per_key.where(~hot_row).drop(count)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
