"""Joins whose hot keys can be split at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join a side that may repeat a key very often to one that was just grouped by it.

    A grouped side would be joined in place, without a shuffle of its own, and
    adaptive execution splits hot keys only between two shuffles. A hash of the
    keys as one more key makes both sides shuffle.
    """
    mark = F.xxhash64(*keys)
    return left.withColumn("_mark", mark).join(right.withColumn("_mark", mark), [*keys, "_mark"], how).drop("_mark")
