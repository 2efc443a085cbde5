"""Lowering predicates to Spark columns.

Predicates have two truth values, SQL has three.  At the root of a filter,
through and/or, a leaf may be null where it means false, and stays in a form
that Parquet scans push down.  Below a negation, which moves inwards, and where
the value itself is used, leaves are made total.
"""

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from poolwright.functions.predicate import LOWER, UPPER, And, Constant, Leaf, Not, Or, Predicate, Xor, ascii_fold


def ascii_folded(c: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(c, UPPER, LOWER)


def condition(p: Predicate, negate: bool = False) -> Column:
    """A column that is true where ``p`` holds (does not, if ``negate``) and
    false or null elsewhere."""
    match p:
        case Constant(value):
            return F.lit(value != negate)
        case Not(of):
            return condition(of, not negate)
        case And(of) | Or(of):
            every = isinstance(p, And) != negate
            return reduce(and_ if every else or_, (condition(x, negate) for x in of)) if of else F.lit(every)
        case Xor(left, right):
            return (total(left) == total(right)) if negate else (total(left) != total(right))
    return ~total(p) if negate else _leaf(p)


def total(p: Predicate) -> Column:
    """The truth of ``p`` as true or false, never null."""
    return F.coalesce(condition(p), F.lit(False))


def _leaf(p: Predicate) -> Column:
    if not isinstance(p, Leaf):
        return p.lower()
    c = F.col(f"`{p.field}`")
    if p.op in ("is_null", "is_not_null"):
        return c.isNull() if p.op == "is_null" else c.isNotNull()
    if isinstance(p.kind, T.StringType) and p.op in TEXT:
        return TEXT[p.op](c, p.operand)
    if p.op == "between":
        low, high = (Leaf(p.field, op, v, p.present, p.kind, p.nullable) for op, v in (("gte", p.operand[0]), ("lte", p.operand[1])))
        return _leaf(low) & _leaf(high)
    if p.op == "in":
        values = [v for v in p.operand if v is not None and not _nan(v)]
        found = c.isin(*(_literal(v, p.kind) for v in values)) if values else F.lit(False)
        return found | c.isNull() if None in p.operand else found
    if p.op == "not_in":
        absent = ~F.coalesce(_leaf(Leaf(p.field, "in", p.operand, p.present, p.kind, p.nullable)), F.lit(False))
        return c.isNotNull() & absent if p.present else absent
    return _compare(p, c)


def _nan(v) -> bool:
    return isinstance(v, float) and math.isnan(v)


def _literal(v, kind: T.DataType | None) -> Column:
    return F.lit(v) if kind is None else F.lit(v).cast(kind)


def _compare(p: Leaf, c: Column) -> Column:
    null = c.isNull() if p.nullable and not p.present else F.lit(False)
    if p.operand is None:  # null is a value and the least
        return {"eq": null, "neq": c.isNotNull(), "gt": c.isNotNull(), "gte": F.lit(True), "lt": F.lit(False), "lte": null}[p.op]
    if _nan(p.operand):
        return {"neq": c.isNotNull() | null, "lt": null, "lte": null}.get(p.op, F.lit(False))
    v = _literal(p.operand, p.kind)
    numbers = ~F.isnan(c) if isinstance(p.kind, (T.FloatType, T.DoubleType)) else None
    match p.op:
        case "eq":
            return c == v
        case "neq":
            return null | (c != v)
        case "gt":
            return c > v if numbers is None else (c > v) & numbers
        case "gte":
            return c >= v if numbers is None else (c >= v) & numbers
        case "lt":
            return null | (c < v) if p.nullable and not p.present else c < v
        case "lte":
            return null | (c <= v) if p.nullable and not p.present else c <= v
    raise ValueError(p.op)


TEXT = {
    "contains": lambda c, s: F.contains(c, F.lit(s)),
    "starts_with": lambda c, s: F.startswith(c, F.lit(s)),
    "ends_with": lambda c, s: F.endswith(c, F.lit(s)),
    "icontains": lambda c, s: F.contains(ascii_folded(c), F.lit(ascii_fold(s))),
    "istarts_with": lambda c, s: F.startswith(ascii_folded(c), F.lit(ascii_fold(s))),
    "iends_with": lambda c, s: F.endswith(ascii_folded(c), F.lit(ascii_fold(s))),
    "iexact": lambda c, s: ascii_folded(c) == F.lit(ascii_fold(s)),
}


def to_sql(p: Predicate) -> str:
    """A readable SQL-like form, for logs and for sources that take text."""
    match p:
        case Constant(value):
            return str(value).upper()
        case Not(of):
            return f"NOT ({to_sql(of)})"
        case And(of):
            return " AND ".join(f"({to_sql(x)})" for x in of) or "TRUE"
        case Or(of):
            return " OR ".join(f"({to_sql(x)})" for x in of) or "FALSE"
        case Xor(left, right):
            return f"({to_sql(left)}) XOR ({to_sql(right)})"
        case Leaf():
            return f"{p.field}{' PRESENT' if p.present else ''} {p.op} {p.operand!r}"
    return repr(p)
