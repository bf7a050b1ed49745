"""Set operations: union by name, full-row de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Concatenate by column name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop full-row duplicates (hash aggregate on all columns, partial before the shuffle)."""
    return df.dropDuplicates()
