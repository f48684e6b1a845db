"""Evaluation of circuits, and what can be done with the selected rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import block_key, lane, page
from sluice.operators.reducers import Reducer
from sluice.operators.terms import NOTHING, Circuit, Slice, Term
from sluice.plans.context import ROW_ID, QueryContext

BLOCK = "block_key"


@dataclass(frozen=True)
class Selection:
    """Rows of a context that a circuit selects.

    ``every`` restricts them to blocks in which every named filter has a row.
    ``term`` is None where the circuit gave none: then no block is present.
    """

    ctx: QueryContext
    term: Term | None
    names: tuple[str, ...]
    every: bool = False

    @property
    def predicate(self) -> Column:
        return (self.term or NOTHING).column({n: self.ctx.filter(n) for n in self.ctx.predicates})

    def _scan(self) -> DataFrame:
        """The context's rows that the circuit selects, before the block rule."""
        term = (self.term or NOTHING).simplified()
        implied = term.implied(self.ctx.predicates)
        if implied is not None and term.monotone:
            return self.ctx.df.where(implied)
        df = self.ctx.df if implied is None else self.ctx.df.where(implied)
        return df.where(self.predicate)

    def source(self) -> DataFrame:
        """The selected rows with the columns of the context's table."""
        # a row in all filters is in a block that all filters have
        if not self.every or (self.term is not None and (self.term.simplified().conjoined() or set()) >= set(self.names)):
            return self._scan()
        # one row a block; the planner broadcasts it if its measured size allows
        blocks = self.blocks().withColumnRenamed(BLOCK, "_block")
        return self._scan().join(blocks, self.ctx.block == F.col("_block"), "left_semi")

    def rows(self) -> DataFrame:
        """row_id of each selected row."""
        return self.source().select(self.ctx.row_id.alias(ROW_ID))

    def blocks(self) -> DataFrame:
        """Blocks on which the circuit is evaluated: those that any, or every, named filter has a row in."""
        held = [self.ctx.filter(n) for n in self.names]
        df = self.ctx.df.where(F.lit(self.term is not None))
        if not self.every:
            return df.where(reduce(lambda a, b: a | b, held)).select(self.ctx.block.alias(BLOCK)).distinct()
        found = df.groupBy(self.ctx.block.alias(BLOCK)).agg(*(F.bool_or(f).alias(f"_{i}") for i, f in enumerate(held)))
        return found.where(reduce(lambda a, b: a & b, (F.col(f"_{i}") for i in range(len(held))))).select(BLOCK)

    def reduce(self, **reducers: Reducer) -> DataFrame:
        """One row with a column for each reducer, all computed in one pass over the selected rows."""
        partials = {f"{name}__{part}": column for name, r in reducers.items() for part, column in r.partials(self.ctx).items()}
        sums = self.source().agg(*(c.alias(n) for n, c in partials.items()))
        return sums.select(*(r.finish({p: F.col(f"{name}__{p}") for p in r.parts}).alias(name) for name, r in reducers.items()))

    def value(self, reducer: Reducer):
        return self.reduce(value=reducer).first()[0]

    def cardinality(self) -> int:
        return self.source().count()

    def found(self, first: int, last: int | None = None) -> DataFrame:
        """One row, ``found``: whether a row with this id, or one of a range with both ends, is selected; the ids reach the scan."""
        within = F.col(ROW_ID) == first if last is None else F.col(ROW_ID).between(first, last)
        return self.rows().where(within).limit(1).agg((F.count("*") > 0).alias("found"))

    def contains(self, first: int, last: int | None = None) -> bool:
        return self.found(first, last).first()[0]

    def reduce_batches(self, partial: Callable[[pa.Table], pa.Table], merge: Callable[[pa.Table], pa.Table], schema: str, *columns: Column) -> DataFrame:
        """An aggregate that columns can't express: ``partial`` of the columns' rows some thousands at a time, ``merge`` of what tasks have.

        ``merge`` must be associative and give few rows; each task merges its own before one task merges theirs.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                new = partial(pa.Table.from_batches([batch]))
                held = new if held is None else merge(pa.concat_tables([held, new]))
            if held is not None:
                yield from held.to_batches()

        parts = self.source().select(*columns).mapInArrow(run, schema)
        return parts.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(lambda t: merge(t.drop_columns("_all")), schema)

    def is_empty(self) -> bool:
        """No block was evaluated; a block whose result is empty still counts as present."""
        return self.blocks().isEmpty()

    def has_no_rows(self) -> bool:
        return self.source().isEmpty()

    def block_cardinality(self) -> DataFrame:
        return self.source().groupBy(self.ctx.block.alias(BLOCK)).agg(F.count("*").alias("rows"))

    def pages(self, metric: str | None = None) -> DataFrame:
        """block_key, page, rows and, with a metric, its values as an array of (slot, value)."""
        row_id = self.ctx.row_id
        keys = [self.ctx.block.alias(BLOCK), page(row_id, self.ctx.block_bits).alias("page")]
        aggs = [F.count("*").alias("rows")]
        if metric:
            # a page has 1024 slots at most
            aggs.append(F.sort_array(F.collect_list(F.struct(row_id.bitwiseAND(1023).alias("slot"), self.ctx.metric(metric).alias("value")))).alias("values"))
        return self.source().groupBy(*keys).agg(*aggs)

    def lanes(self, metric: str, lanes: int = 1024) -> DataFrame:
        """The metric summed by row id modulo ``lanes``."""
        return self.source().groupBy(lane(self.ctx.row_id, lanes).alias("lane")).agg(F.sum(self.ctx.metric(metric)).alias("total"))

    def as_filter(self, name: str) -> QueryContext:
        """The context with this selection as a further filter."""
        if not self.every:
            return self.ctx.with_filter(name, self.predicate)
        blocks = self.blocks().select(F.col(BLOCK).alias("_block"), F.lit(True).alias("_present"))
        marked = self.ctx.df.join(blocks, self.ctx.block == F.col("_block"), "left").drop("_block").withColumnRenamed("_present", f"_in_{name}")
        return replace(self.ctx, df=marked, predicates=self.ctx.predicates | {name: F.coalesce(F.col(f"_in_{name}"), F.lit(False)) & self.predicate})

    def fold(self, initial: Column, value: Column, combine: Callable[[Column, Column], Column]) -> DataFrame:
        """One row, ``value``: the values folded in row order with an associative function.

        Rows are folded by block, then block results by groups of as many blocks,
        and so on; no task holds more than one group.  The largest id, which tells
        how many times, is looked up first; negative ids are refused.
        """
        bits = self.ctx.block_bits
        part = self.source().select(self.ctx.row_id.alias("k"), value.alias("v"))
        least, top = part.agg(F.min("k"), F.max("k")).first()
        if least is not None and least < 0:
            raise ValueError(f"row ids start from 0; there is {least}")

        def ordered(rows: Column) -> Column:
            vs = F.transform(F.sort_array(rows), lambda r: r["v"])
            return F.aggregate(F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0))), F.element_at(vs, 1), combine)

        while top:
            part = part.groupBy(block_key(F.col("k"), bits).alias("b")).agg(F.collect_list(F.struct("k", "v")).alias("rows"))
            part = part.select(F.col("b").alias("k"), ordered(F.col("rows")).alias("v"))
            top >>= bits
        folded = F.max("v")
        return part.agg(F.when(folded.isNull(), initial).otherwise(combine(initial, folded)).alias("value"))


def _check(ctx: QueryContext, names: tuple[str, ...]) -> None:
    if not names:
        raise ValueError("a circuit needs a named filter")
    for n in names:
        ctx.predicate(n)


def evaluate(ctx: QueryContext, circuit: Circuit, *names: str) -> Selection:
    """The circuit on every block that any of the named filters has a row in."""
    _check(ctx, names)
    return Selection(ctx, circuit(Slice(names)), names)


def evaluate_if_keys_intersect(ctx: QueryContext, circuit: Circuit, *names: str) -> Selection:
    """The circuit only on blocks in which every named filter has a row."""
    _check(ctx, names)
    return Selection(ctx, circuit(Slice(names)), names, every=True)


def select_filter(ctx: QueryContext, name: str) -> Selection:
    """A stored filter as a selection, without a circuit."""
    return evaluate(ctx, lambda s: s[name], name)
