"""Column functions on row ids and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a block, of a page and of a bitmap word, as powers of two.
BLOCK_BITS, PAGE_BITS, WORD_BITS = 16, 10, 6

NAN = float("nan")


def block_key(row_id: Column, bits: int = BLOCK_BITS) -> Column:
    """The block of a row: ids 0 to 2**bits - 1 are block 0."""
    return F.shiftright(row_id, bits)


def page(row_id: Column, block_bits: int = BLOCK_BITS, page_bits: int = PAGE_BITS) -> Column:
    """The page of a row within its block."""
    return F.shiftright(row_id.bitwiseAND((1 << block_bits) - 1), page_bits)


def slot(row_id: Column, page_bits: int = PAGE_BITS) -> Column:
    """The place of a row within its page."""
    return row_id.bitwiseAND((1 << page_bits) - 1)


def lane(row_id: Column, lanes: int = 1 << PAGE_BITS) -> Column:
    return F.pmod(row_id, F.lit(lanes))


def bit_reverse(key: Column, bits: int = 16) -> Column:
    """The low bits of the key in the opposite order, higher ones don't count; applied twice it is the low bits again."""
    low = key.cast("long").bitwiseAND((1 << bits) - 1)
    return F.conv(F.reverse(F.lpad(F.bin(low), bits, "0")), 2, 10).cast("int")


def vector_add(left: Column, right: Column) -> Column:
    """Elementwise sum of two arrays of doubles; a null array counts as absent, other lengths are an error."""
    unequal = F.raise_error(F.lit("vectors differ in length")).cast("array<double>")
    both = F.when(F.size(left) == F.size(right), F.zip_with(left, right, lambda a, b: a + b)).otherwise(unequal)
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(both)


def horizontal_sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def fold_array(array: Column, initial: Column, combine: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(array, initial, combine)


def or_nan(value: Column) -> Column:
    return F.coalesce(value, F.lit(NAN))
