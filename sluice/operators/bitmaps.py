"""Materialised row sets: 64-bit words by filter, for many circuits over the same filters.

Row n is bit n % 64 of word n / 64.  A circuit is evaluated word by word after
one aggregation by word key; its answers equal those of the row form.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import WORD_BITS
from sluice.operators.selection import Selection
from sluice.operators.terms import Circuit, Slice, Term
from sluice.plans.context import ROW_ID, QueryContext

#: Filters up to which words are made side by side.
FEW = 64


def _bit(row_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), row_id.bitwiseAND(63).cast("int"))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def word_index(ctx: QueryContext, *names: str) -> DataFrame:
    """word_key and a column of words for each filter, named like it: one pass, one row shuffled for each word.

    Persisted or written, it answers any circuit over these filters word by word without a shuffle.
    """
    bit = _bit(ctx.row_id)
    words = (F.coalesce(F.bit_or(F.when(ctx.filter(n), bit)), F.lit(0).cast("long")).alias(n) for n in names)
    return ctx.df.where(ctx.row_id.isNotNull()).groupBy(F.shiftright(ctx.row_id, WORD_BITS).alias("word_key")).agg(*words)


def indexed_words(index: DataFrame, circuit: Circuit, *names: str) -> DataFrame:
    """word_key, word of a circuit over an index; only words with a row."""
    if not names:
        raise ValueError("a circuit needs a named filter")
    term = circuit(Slice(names))
    word = F.lit(0).cast("long") if term is None else term.words({n: _quoted(n) for n in names})
    return index.select("word_key", word.alias("word")).where("word <> 0")


def filter_words(ctx: QueryContext, *names: str) -> DataFrame:
    """name, word_key, word for each filter and word with a row: one pass over the table."""
    if len(names) <= FEW:
        pairs = F.array(*(F.struct(F.lit(n).alias("name"), _quoted(n).alias("word")) for n in names))
        found = word_index(ctx, *names).select("word_key", F.explode(pairs).alias("w"))
        return found.select("w.name", "word_key", "w.word").where("word <> 0")
    held = F.filter(F.array(*(F.when(ctx.filter(n), F.lit(n)) for n in names)), lambda n: n.isNotNull())
    rows = ctx.df.select(ctx.row_id.alias(ROW_ID), F.explode(held).alias("name"))
    return rows.groupBy("name", F.shiftright(ROW_ID, WORD_BITS).alias("word_key")).agg(F.bit_or(_bit(F.col(ROW_ID))).alias("word"))


def words_of_rows(rows: DataFrame, name: str) -> DataFrame:
    """The words of an explicit list of row ids; repeats and order don't matter."""
    words = rows.groupBy(F.shiftright(ROW_ID, WORD_BITS).alias("word_key")).agg(F.bit_or(_bit(F.col(ROW_ID))).alias("word"))
    return words.select(F.lit(name).alias("name"), "word_key", "word")


def circuit_words(words: DataFrame, circuit: Circuit, *names: str) -> DataFrame:
    """word_key, word of the circuit's result; only words with a row."""
    if not names:
        raise ValueError("a circuit needs a named filter")
    term = circuit(Slice(names))
    aggs = [F.coalesce(F.bit_or(F.when(F.col("name") == n, F.col("word"))), F.lit(0).cast("long")).alias(f"_{i}") for i, n in enumerate(names)]
    wide = words.where(F.col("name").isin(*names)).groupBy("word_key").agg(*aggs)
    word = F.lit(0).cast("long") if term is None else term.words({n: F.col(f"_{i}") for i, n in enumerate(names)})
    return wide.select("word_key", word.alias("word")).where("word <> 0")


def cardinality(words: DataFrame) -> DataFrame:
    return words.agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("long").alias("rows"))


def selected(ctx: QueryContext, words: DataFrame) -> Selection:
    """The context's rows in a set of words, to be reduced like any selection: blocks of 64 rows without one aren't read on."""
    kept = words.select(F.col("word_key").alias("_word_key"), F.col("word").alias("_word"))
    met = ctx.df.join(kept, F.shiftright(ctx.row_id, WORD_BITS) == F.col("_word_key")).where(F.col("_word").bitwiseAND(_bit(ctx.row_id)) != 0)
    return Selection(replace(ctx, df=met.drop("_word_key", "_word"), predicates={"words": F.lit(True)}), Term("name", "words"), ("words",))


def rows_of_words(words: DataFrame) -> DataFrame:
    """row_id of each set bit."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("word"), i).bitwiseAND(1) == 1)
    return words.select("word_key", F.explode(bits).alias("bit")).select((F.shiftleft("word_key", WORD_BITS) + F.col("bit")).alias(ROW_ID))


def contains(words: DataFrame, row_id: int) -> bool:
    at = words.where(F.col("word_key") == row_id >> WORD_BITS).where(F.col("word").bitwiseAND(_bit(F.lit(row_id).cast("long"))) != 0)
    return bool(at.limit(1).count())


def bucket_bitmaps(ctx: QueryContext, *names: str) -> DataFrame:
    """name, bucket, bitmap in Spark's own binary bitmaps of 32,768 rows, for its bitmap aggregates."""
    held = F.filter(F.array(*(F.when(ctx.filter(n), F.lit(n)) for n in names)), lambda n: n.isNotNull())
    # Spark counts positions from 1
    rows = ctx.df.select((ctx.row_id + 1).alias("at"), F.explode(held).alias("name"))
    return rows.groupBy("name", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def union_count(bitmaps: DataFrame) -> DataFrame:
    """Rows in any of the filters whose bitmaps are given."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("b")).agg(F.coalesce(F.sum(F.bitmap_count("b")), F.lit(0)).cast("long").alias("rows"))


def intersection_count(bitmaps: DataFrame, filters: int) -> DataFrame:
    """Rows in all of the ``filters`` filters; a bucket that one lacks has none."""
    both = bitmaps.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("b"), F.count("*").alias("n")).where(F.col("n") == filters)
    return both.agg(F.coalesce(F.sum(F.bitmap_count("b")), F.lit(0)).cast("long").alias("rows"))
