"""Joins whose hot keys are known from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHARE = 1000
_MOST_KEYS = 1_000_000  # of a few numbers each: some 40 MB


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``table``, which has one row a key and the number of ``rows`` of that key in ``count``.

    Keys with more than a thousandth of the ``total`` rows are fewer than a thousand, so these are broadcast and their rows
    stay where they are; all others are shuffled, and none of them makes a large task. Null keys join nothing, and where
    they are many they should be left to "inner"."""
    hot = F.broadcast(table.where(F.col(count) * _SHARE > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) * _SHARE <= total), key, how)
    return rows.join(hot, key).unionByName(rest)


def drop_rows(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``gone``, a stored table of keys. Where these are few, as their count tells, they are broadcast
    and no row moves; beyond that both sides are shuffled once."""
    return rows.join(F.broadcast(gone) if gone.count() <= _MOST_KEYS else gone, key, "left_anti")
