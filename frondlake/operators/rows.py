"""Helpers for one-row results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row frames side by side (a union, not a join)."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def join_group_rows(rows: DataFrame, groups: DataFrame, key: str, size_col: str,
                    heavy: int = 1000) -> DataFrame:
    """Inner join of rows with one row per group when a few groups may be huge.

    The ``heavy`` largest groups are broadcast (their number is the bound), so
    their members are not shuffled; every other group holds at most
    ``1 / heavy`` of the rows and goes through a shuffle join.
    """
    largest = F.broadcast(groups.orderBy(F.desc(size_col), key).limit(heavy))
    keys = F.broadcast(largest.select(key))
    return rows.join(largest, key).unionByName(
        rows.join(keys, key, "left_anti").join(groups.join(keys, key, "left_anti"), key)
    )
