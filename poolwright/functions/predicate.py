"""The predicate algebra: an inspectable tree with two truth values.

Combining with ``& | ^ ~`` flattens and/or and removes double negation;
nothing else is rewritten.  Leaves name a column, an operation and its operand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from poolwright.errors import ConfigError


class Predicate:
    def __and__(self, other) -> Predicate:
        return And((*_parts(And, self), *_parts(And, as_predicate(other))))

    def __or__(self, other) -> Predicate:
        return Or((*_parts(Or, self), *_parts(Or, as_predicate(other))))

    def __xor__(self, other) -> Predicate:
        return Xor(self, as_predicate(other))

    def __invert__(self) -> Predicate:
        return FALSE if self == TRUE else TRUE if self == FALSE else Not(self)

    def __bool__(self):
        raise TypeError("combine predicates with & | ^ ~")

    def leaves(self) -> Iterator[Leaf]:
        """Every leaf from left to right, for replaying a filter at a source."""
        for x in self.children():
            yield from x.leaves()

    def children(self) -> tuple[Predicate, ...]:
        return ()


def _parts(kind: type, p: Predicate) -> tuple[Predicate, ...]:
    return p.of if isinstance(p, kind) else (p,)


def as_predicate(x) -> Predicate:
    """A predicate as it is, or what an object's ``__as_predicate__`` returns."""
    if isinstance(x, Predicate):
        return x
    if hasattr(x, "__as_predicate__"):
        return as_predicate(x.__as_predicate__())
    if isinstance(x, bool):
        return TRUE if x else FALSE
    raise TypeError(f"{x!r} is no predicate")


@dataclass(frozen=True)
class Constant(Predicate):
    value: bool


TRUE, FALSE = Constant(True), Constant(False)


@dataclass(frozen=True)
class And(Predicate):
    of: tuple[Predicate, ...]

    def children(self):
        return self.of


@dataclass(frozen=True)
class Or(Predicate):
    of: tuple[Predicate, ...]

    def children(self):
        return self.of


@dataclass(frozen=True)
class Xor(Predicate):
    left: Predicate
    right: Predicate

    def children(self):
        return (self.left, self.right)


@dataclass(frozen=True)
class Not(Predicate):
    of: Predicate

    def __invert__(self):
        return self.of

    def children(self):
        return (self.of,)


@dataclass(frozen=True)
class Leaf(Predicate):
    """``present`` leaves are false for null; others order null first and
    treat it as a value.  ``kind`` and ``nullable`` are the column's."""

    field: str
    op: str
    operand: Any = None
    present: bool = False
    kind: T.DataType | None = None
    nullable: bool = True

    def leaves(self):
        yield self

    def operand_as(self, kind: type):
        """The operand if it is of ``kind``, else None."""
        return self.operand if isinstance(self.operand, kind) else None


class _Lookups:
    name: str
    kind: T.DataType
    nullable: bool
    present = False

    def _leaf(self, op: str, operand=None) -> Leaf:
        return Leaf(self.name, op, operand, self.present, self.kind, self.nullable)

    def eq(self, v) -> Leaf:
        return self._leaf("eq", v)

    def neq(self, v) -> Leaf:
        return self._leaf("neq", v)

    def gt(self, v) -> Leaf:
        return self._leaf("gt", v)

    def gte(self, v) -> Leaf:
        return self._leaf("gte", v)

    def lt(self, v) -> Leaf:
        return self._leaf("lt", v)

    def lte(self, v) -> Leaf:
        return self._leaf("lte", v)

    def between(self, low, high) -> Leaf:
        """Both ends belong; ``low`` above ``high`` gives nothing."""
        return self._leaf("between", (low, high))

    def in_(self, values) -> Leaf:
        return self._leaf("in", tuple(values))

    def not_in(self, values) -> Leaf:
        return self._leaf("not_in", tuple(values))


@dataclass(frozen=True)
class Present(_Lookups):
    """A nullable column seen as in SQL: no lookup holds for null."""

    name: str
    kind: T.DataType
    nullable: bool = True
    present = True

    def _leaf(self, op: str, operand=None) -> Leaf:
        values = operand if isinstance(operand, tuple) else (operand,)
        if any(v is None for v in values):
            raise ConfigError("a present lookup takes no null")
        return super()._leaf(op, operand)


@dataclass(frozen=True)
class Field(_Lookups):
    """A typed column; null is a value, less than all others."""

    name: str
    kind: T.DataType
    nullable: bool = True

    def some(self) -> Present:
        if not self.nullable:
            raise ConfigError(f"{self.name} is never null")
        return Present(self.name, self.kind)

    def is_null(self) -> Leaf:
        return self._leaf("is_null")

    def is_not_null(self) -> Leaf:
        return self._leaf("is_not_null")

    def _text(self, op: str, s: str) -> Leaf:
        if not isinstance(self.kind, T.StringType) or self.nullable:
            raise ConfigError(f"{self.name}: string lookups are for string columns that are not nullable")
        return self._leaf(op, s)

    def contains(self, s: str) -> Leaf:
        return self._text("contains", s)

    def icontains(self, s: str) -> Leaf:
        return self._text("icontains", s)

    def starts_with(self, s: str) -> Leaf:
        return self._text("starts_with", s)

    def istarts_with(self, s: str) -> Leaf:
        return self._text("istarts_with", s)

    def ends_with(self, s: str) -> Leaf:
        return self._text("ends_with", s)

    def iends_with(self, s: str) -> Leaf:
        return self._text("iends_with", s)

    def iexact(self, s: str) -> Leaf:
        return self._text("iexact", s)

    def json(self, *segments: str):
        """Predicates on the JSON value of this column (variant or JSON text)."""
        from poolwright.functions.json import JsonRef

        return JsonRef(self.name, segments)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_FOLD = str.maketrans(UPPER, LOWER)


def ascii_fold(s: str) -> str:
    return s.translate(ASCII_FOLD)


TEXT_TESTS: dict[str, Callable[[str, str], bool]] = {
    "contains": lambda c, s: s in c,
    "starts_with": str.startswith,
    "ends_with": str.endswith,
    "icontains": lambda c, s: ascii_fold(s) in ascii_fold(c),
    "istarts_with": lambda c, s: ascii_fold(c).startswith(ascii_fold(s)),
    "iends_with": lambda c, s: ascii_fold(c).endswith(ascii_fold(s)),
    "iexact": lambda c, s: ascii_fold(c) == ascii_fold(s),
}


def _less(a, b) -> bool:
    """a < b with null first."""
    return b is not None if a is None else b is not None and a < b


def evaluate(p: Predicate, row: dict) -> bool:
    """The truth of ``p`` for one row, without Spark."""
    match p:
        case Constant(value):
            return value
        case And(of):
            return all(evaluate(x, row) for x in of)
        case Or(of):
            return any(evaluate(x, row) for x in of)
        case Xor(left, right):
            return evaluate(left, row) != evaluate(right, row)
        case Not(of):
            return not evaluate(of, row)
        case Leaf():
            return _evaluate_leaf(p, row[p.field])
    return p.evaluate(row)


def _evaluate_leaf(p: Leaf, c) -> bool:
    if p.present and c is None:
        return False
    v = p.operand
    at_least = lambda v: not _less(c, v) and (c == v or _less(v, c))  # noqa: E731  NaN is in no order
    at_most = lambda v: c == v or _less(c, v)
    match p.op:
        case "eq":
            return c == v
        case "neq":
            return c != v
        case "gt":
            return _less(v, c)
        case "gte":
            return at_least(v)
        case "lt":
            return _less(c, v)
        case "lte":
            return at_most(v)
        case "between":
            return at_least(v[0]) and at_most(v[1])
        case "in":
            return any(c == x for x in v)
        case "not_in":
            return not any(c == x for x in v)
        case "is_null":
            return c is None
        case "is_not_null":
            return c is not None
    return TEXT_TESTS[p.op](c, v)
