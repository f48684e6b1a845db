"""Aggregates over a selection: partial columns and a finishing expression.

Several reducers over one selection are computed in one pass.  Empty selections
give 0.0 for sums, 0 for counts and NaN for ratios and correlations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import or_nan
from sluice.plans.context import QueryContext

Parts = dict[str, Column]


@dataclass(frozen=True)
class Reducer:
    """``build`` gives named aggregate columns of a context, ``finish`` the result from them.

    A user-defined aggregate is one more instance of this class.
    """

    parts: tuple[str, ...]
    build: Callable[[QueryContext], Parts]
    finish: Callable[[Parts], Column]

    def partials(self, ctx: QueryContext) -> Parts:
        found = self.build(ctx)
        if set(found) != set(self.parts):
            raise ValueError(f"expected the parts {self.parts}")
        return found


    def typed(self, kind: str) -> Reducer:
        """The same result as another type, such as long or string."""
        return replace(self, finish=lambda p: self.finish(p).cast(kind))


def total(x: str) -> Reducer:
    """The sum of a metric."""
    return Reducer(("s",), lambda c: {"s": F.sum(c.metric(x))}, lambda p: F.coalesce(p["s"], F.lit(0.0)))


def sum_product(x: str, y: str) -> Reducer:
    return Reducer(("s",), lambda c: {"s": F.sum(c.metric(x) * c.metric(y))}, lambda p: F.coalesce(p["s"], F.lit(0.0)))


def average(x: str) -> Reducer:
    """The sum by the number of selected rows, rows without a value included."""
    return Reducer(("s", "n"), lambda c: {"s": F.sum(c.metric(x)), "n": F.count("*")}, lambda p: or_nan(F.try_divide(p["s"], p["n"])))


def count() -> Reducer:
    return Reducer(("n",), lambda c: {"n": F.count("*")}, lambda p: p["n"])


MOMENTS = ("sx", "sy", "sxx", "syy", "sxy", "n")


def _moments(x: str, y: str, ctx: QueryContext) -> Parts:
    a, b = ctx.metric(x), ctx.metric(y)
    return {"sx": F.sum(a), "sy": F.sum(b), "sxx": F.sum(a * a), "syy": F.sum(b * b), "sxy": F.sum(a * b), "n": F.count("*").cast("double")}


def regression_moments(x: str, y: str) -> Reducer:
    """The sums of x, y, xx, yy and xy and the count, as a struct."""
    return Reducer(MOMENTS, lambda c: _moments(x, y, c), lambda p: F.struct(*(F.coalesce(p[m], F.lit(0.0)).alias(m) for m in MOMENTS)))


def correlation(x: str, y: str) -> Reducer:
    """Pearson's r from centred moments, which merge without cancellation; NaN for fewer than two rows or a constant."""

    def build(c: QueryContext) -> Parts:
        a, b = c.metric(x), c.metric(y)
        return {"xy": F.regr_sxy(b, a), "xx": F.regr_sxx(b, a), "yy": F.regr_syy(b, a)}

    return Reducer(("xy", "xx", "yy"), build, lambda p: or_nan(F.try_divide(p["xy"], F.sqrt(p["xx"] * p["yy"]))))


def ratio_of_sums(over: Callable[[QueryContext], Column], under: Callable[[QueryContext], Column]) -> Reducer:
    """A weighted mean or another quotient of two sums; NaN over nothing."""
    return Reducer(("a", "b"), lambda c: {"a": F.sum(over(c)), "b": F.sum(under(c))}, lambda p: or_nan(F.try_divide(p["a"], p["b"])))


def folded(value: Callable[[QueryContext], Column], initial: Column, aggregate: Callable[[Column], Column] = F.sum, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Reducer:
    """``initial`` joined with an aggregate of mapped values, as with sum and +, max and greatest."""
    return Reducer(("v",), lambda c: {"v": aggregate(value(c))}, lambda p: F.when(p["v"].isNull(), initial).otherwise(join(initial, p["v"])))
