"""Sparse tables by key: point lookup, upsert and folds over values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class KeyedTable:
    """One value of any type for each key (columns key and value)."""

    def __init__(self, df: DataFrame):
        self.df = df.select("key", "value")

    def get(self, key: int):
        """The key's value, or None."""
        found = self.df.where(F.col("key") == key).limit(1).collect()
        return found[0]["value"] if found else None

    def upsert(self, other: DataFrame) -> KeyedTable:
        """Rows of ``other`` replace those with the same key."""
        other = other.select("key", "value")
        return KeyedTable(self.df.join(other, "key", "left_anti").unionByName(other))

    def window(self, first: int, size: int) -> KeyedTable:
        """Keys from ``first``, ``size`` of them."""
        return KeyedTable(self.df.where(F.col("key").between(first, first + size - 1)))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def fold(self, initial: Column, value: Callable[[Column], Column], key: Callable[[Column], Column] | None = None, aggregate: Callable[[Column], Column] = F.sum, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> DataFrame:
        """``initial`` joined with an aggregate of value(v), times key(k) where given."""
        mapped = value(F.col("value"))
        if key is not None:
            mapped = mapped * key(F.col("key"))
        found = aggregate(mapped)
        return self.df.agg(F.when(found.isNull(), initial).otherwise(join(initial, found)).alias("value"))

    def fold_pairs(self, initial: Column, value: Callable[[Column, Column], Column], aggregate: Callable[[Column], Column] = F.sum, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> DataFrame:
        """``initial`` joined with an aggregate of any function of key and value."""
        found = aggregate(value(F.col("key"), F.col("value")))
        return self.df.agg(F.when(found.isNull(), initial).otherwise(join(initial, found)).alias("value"))

    def merge(self, other: KeyedTable, every: bool = False) -> DataFrame:
        """key, value, other: keys of either table, or only those of both."""
        return self.df.join(other.df.withColumnRenamed("value", "other"), "key", "inner" if every else "full_outer")
