"""Set operations on materialised row ids (DataFrames with the column row_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))
