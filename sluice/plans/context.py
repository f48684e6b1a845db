"""Datasets: named filters and metrics over a table.

A :class:`DatasetSpec` is written once and laid over any DataFrame; that gives an
immutable :class:`QueryContext`, a lazy projection that is fused into each query.
Filters that are null count as false, metrics that are null count as 0.0.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import BLOCK_BITS, WORD_BITS, block_key

ROW_ID = "row_id"


@dataclass(frozen=True)
class DatasetSpec:
    """Expressions may be SQL text, which needs no session until the spec is laid over a table."""

    filters: dict[str, Column | str] = field(default_factory=dict)
    metrics: dict[str, Column | str] = field(default_factory=dict)
    id_column: Column | str | None = None
    block_bits: int = BLOCK_BITS

    def filter(self, name: str, predicate: Column | str) -> DatasetSpec:
        """Adds a named predicate; a name used again is replaced."""
        return replace(self, filters=self.filters | {name: predicate})

    def metric(self, name: str, value: Column | str) -> DatasetSpec:
        return replace(self, metrics=self.metrics | {name: value})

    def row_id(self, column: Column | str, block_bits: int | None = None) -> DatasetSpec:
        """The column that numbers rows; only block and id operators need one."""
        return replace(self, id_column=column, block_bits=block_bits or self.block_bits)

    def over(self, df: DataFrame) -> QueryContext:
        if not self.metrics:
            raise ValueError("a dataset needs a metric")
        metrics = {n: F.coalesce(_column(m).cast("double"), F.lit(0.0)) for n, m in self.metrics.items()}
        row_id = None if self.id_column is None else _column(self.id_column)
        return QueryContext(df, {n: _column(f) for n, f in self.filters.items()}, metrics, row_id, self.block_bits)


def _column(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class QueryContext:
    df: DataFrame
    predicates: dict[str, Column]
    metrics: dict[str, Column]
    id_column: Column | None = None
    block_bits: int = BLOCK_BITS

    def filter(self, name: str) -> Column:
        """The named filter, never null."""
        return F.coalesce(self.predicates[name], F.lit(False))

    def predicate(self, name: str) -> Column:
        return self.predicates[name]

    def metric(self, name: str) -> Column:
        return self.metrics[name]

    @property
    def row_id(self) -> Column:
        if self.id_column is None:
            raise ValueError("this dataset has no row id")
        return self.id_column.cast("long")

    @property
    def block(self) -> Column:
        return block_key(self.row_id, self.block_bits)

    def with_filter(self, name: str, predicate: Column) -> QueryContext:
        return replace(self, predicates=self.predicates | {name: predicate})

    def _joined(self, rows: DataFrame, key: Column, columns: list[Column], mark: str) -> DataFrame:
        """The table with ``columns`` of other rows, null where there is none; the planner picks the join by size."""
        return self.df.join(rows.select(F.col(rows.columns[0]).alias(mark), *columns), key == F.col(mark), "left")

    def with_rows(self, name: str, rows: DataFrame) -> QueryContext:
        """A further filter that was made elsewhere: a list of row ids, in any order and with repeats."""
        mark = f"_rows_{name}"
        joined = self._joined(rows.select(ROW_ID).where(F.col(ROW_ID).isNotNull()).distinct(), self.row_id, [], mark)
        return replace(self, df=joined, predicates=self.predicates | {name: F.col(mark).isNotNull()})

    def with_words(self, name: str, words: DataFrame) -> QueryContext:
        """A further filter from stored words (word_key, word), such as a circuit's result."""
        mark, word = f"_key_{name}", f"_word_{name}"
        joined = self._joined(words.select("word_key", "word"), F.shiftright(self.row_id, WORD_BITS), [F.col("word").alias(word)], mark)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), self.row_id.bitwiseAND(63).cast("int"))
        return replace(self, df=joined, predicates=self.predicates | {name: F.col(word).bitwiseAND(bit) != 0})

    def with_metric_of(self, name: str, values: DataFrame) -> QueryContext:
        """A further metric that was made elsewhere: (row_id, value), one value a row; rows without one count 0.0."""
        mark, value = f"_id_{name}", f"_value_{name}"
        joined = self._joined(values.select(ROW_ID, "value"), self.row_id, [F.col("value").alias(value)], mark)
        return replace(self, df=joined, metrics=self.metrics | {name: F.coalesce(F.col(value).cast("double"), F.lit(0.0))})

    def persist(self) -> QueryContext:
        """The filters and metrics evaluated once and kept for many queries."""
        names = {n: f"_f{i}" for i, n in enumerate(self.predicates)}
        values = {n: f"_m{i}" for i, n in enumerate(self.metrics)}
        ids = [] if self.id_column is None else [self.row_id.alias(ROW_ID)]
        kept = self.df.select(*ids, *(self.filter(n).alias(c) for n, c in names.items()), *(self.metric(n).alias(c) for n, c in values.items())).persist()
        return QueryContext(kept, {n: F.col(c) for n, c in names.items()}, {n: F.col(c) for n, c in values.items()}, F.col(ROW_ID) if ids else None, self.block_bits)
