"""Boolean circuits over named filters.

A circuit is a function from a :class:`Slice` to a :class:`Term`.  Terms are a
small algebra (``&``, ``|``, ``^``, ``-`` for and-not, ``~``) that is turned into
one Catalyst expression.  A filter counts as false where its predicate is null;
Parquet can't take such a wrapped predicate, so a term also knows a plain
condition that it implies, and that one reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


class Term:
    """``op`` is name, const, and, or, xor, less or not."""

    def __init__(self, op: str, *args):
        self.op, self.args = op, args

    def __and__(self, other: Term) -> Term:
        return Term("and", self, other)

    def __or__(self, other: Term) -> Term:
        return Term("or", self, other)

    def __xor__(self, other: Term) -> Term:
        return Term("xor", self, other)

    def __sub__(self, other: Term) -> Term:
        return Term("less", self, other)

    def __invert__(self) -> Term:
        return Term("not", self)

    def names(self) -> set[str]:
        if self.op == "name":
            return {self.args[0]}
        return set().union(*(a.names() for a in self.args)) if self.op != "const" else set()

    def column(self, filters: Mapping[str, Column]) -> Column:
        """The exact condition; ``filters`` are never null."""
        if self.op == "const":
            return F.lit(self.args[0])
        if self.op == "name":
            return filters[self.args[0]]
        a, *b = (x.column(filters) for x in self.args)
        return {"and": lambda: a & b[0], "or": lambda: a | b[0], "xor": lambda: a != b[0], "less": lambda: a & ~b[0], "not": lambda: ~a}[self.op]()

    def simplified(self) -> Term:
        """The same circuit without constants, or a constant alone, so that a plain condition can reach the scan."""
        if self.op in ("name", "const"):
            return self
        a, *b = (x.simplified() for x in self.args)
        if self.op == "not":
            return Term("const", not a.args[0]) if a.op == "const" else ~a
        b = b[0]
        held = {x.args[0] for x in (a, b) if x.op == "const"}
        if not held:
            return Term(self.op, a, b)
        if self.op == "less":
            if b.op == "const":
                return NOTHING if b.args[0] else a
            return (~b).simplified() if a.args[0] else NOTHING
        if a.op == "const":
            a, b = b, a
        value = b.args[0]
        if self.op == "xor":
            return (~a).simplified() if value else a
        return a if value == (self.op == "and") else Term("const", self.op == "or")

    def conjoined(self) -> set[str] | None:
        """The names of a pure conjunction, or None."""
        if self.op == "name":
            return {self.args[0]}
        if self.op != "and":
            return None
        a, b = (x.conjoined() for x in self.args)
        return None if a is None or b is None else a | b

    def implied(self, predicates: Mapping[str, Column]) -> Column | None:
        """A condition on the plain predicates that every selected row fulfils; None: no such condition."""
        if self.op == "name":
            return predicates[self.args[0]]
        if self.op in ("const", "not"):
            return None
        a, b = (x.implied(predicates) for x in self.args)
        if self.op == "less":
            return a
        if self.op == "and":
            return a & b if a is not None and b is not None else a if b is None else b
        return a | b if a is not None and b is not None else None

    @property
    def monotone(self) -> bool:
        """Only and/or: then the implied condition is the exact one."""
        return self.op == "name" or (self.op in ("and", "or") and all(a.monotone for a in self.args))

    def words(self, words: Mapping[str, Column]) -> Column:
        """The circuit on 64-bit words of row sets; absent words are 0."""
        if self.op == "const":
            return F.lit(-1 if self.args[0] else 0).cast("long")
        if self.op == "name":
            return words[self.args[0]]
        a, *b = (x.words(words) for x in self.args)
        if self.op == "not":
            return F.bitwise_not(a)
        return {"and": lambda: a.bitwiseAND(b[0]), "or": lambda: a.bitwiseOR(b[0]), "xor": lambda: a.bitwiseXOR(b[0]), "less": lambda: a.bitwiseAND(F.bitwise_not(b[0]))}[self.op]()


NOTHING = Term("const", False)

Circuit = Callable[["Slice"], "Term | None"]


class Slice(Mapping):
    """The named filters of one evaluation; a name that isn't among them is ``default``."""

    def __init__(self, names: tuple[str, ...], default: Term = NOTHING):
        self._terms = {n: Term("name", n) for n in names}
        self.default = default

    def __getitem__(self, name: str) -> Term:
        return self._terms.get(name, self.default)

    def get(self, name: str, default: Term | None = None) -> Term:
        return self._terms.get(name, self.default if default is None else default)

    def __contains__(self, name: object) -> bool:
        return name in self._terms

    def __iter__(self) -> Iterator[str]:
        return iter(self._terms)

    def __len__(self) -> int:
        return len(self._terms)

    def terms(self) -> list[Term]:
        return list(self._terms.values())


def balanced(terms: list[Term], join: Callable[[Term, Term], Term]) -> Term:
    """All terms joined as a balanced tree, so that hundreds of them stay a shallow expression."""
    while len(terms) > 1:
        terms = [reduce(join, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0] if terms else NOTHING


def union_of(s: Slice) -> Term:
    """Rows in any of the slice's filters."""
    return balanced(s.terms(), or_)


def intersection_of(s: Slice) -> Term:
    return balanced(s.terms(), lambda a, b: a & b)
