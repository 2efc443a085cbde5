"""Predicates on JSON values: missing, null and mismatch are told apart, and
numbers are compared exactly whatever carries them."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, SparkSession, functions as F

from poolwright.errors import ConfigError, JsonValueError
from poolwright.functions.predicate import Predicate

I64, U64 = -(1 << 63), (1 << 64) - 1
KINDS = ("null", "bool", "number", "string", "array", "object")


# --- values -----------------------------------------------------------------

def check_value(x: Any) -> Any:
    """A portable JSON value, or an error: integers of 64 bits, finite floats."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        if not I64 <= x <= U64:
            raise JsonValueError(f"{x} has more than 64 bits")
        return x
    if isinstance(x, float):
        if not math.isfinite(x):
            raise JsonValueError("numbers are finite")
        return x
    if isinstance(x, (list, tuple)):
        return [check_value(v) for v in x]
    if isinstance(x, dict):
        if any(not isinstance(k, str) for k in x):
            raise JsonValueError("keys are strings")
        return {k: check_value(v) for k, v in x.items()}
    raise JsonValueError(f"{type(x).__name__} is no JSON value")


def parse(text: str) -> Any:
    """JSON text; of a repeated key the last value, at the first one's place.
    Integers beyond 64 bits become floats if finite."""

    def number(s: str):
        n = int(s)
        return n if I64 <= n <= U64 else float(s)

    def no(s: str):
        raise JsonValueError(s)

    return check_value(json.loads(text, object_pairs_hook=dict, parse_int=number, parse_constant=no))


def kind_of(x: Any) -> str:
    return "null" if x is None else "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def deep_equal(a: Any, b: Any) -> bool:
    """Equality with one domain of numbers and unordered keys; Python compares
    integers with floats exactly."""
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(deep_equal(v, b[k]) for k, v in a.items())
    return a == b


MISSING = object()


def resolve(x: Any, path: tuple[str, ...]) -> Any:
    for key in path:
        if not isinstance(x, dict) or key not in x:
            return MISSING
        x = x[key]
    return x


# --- references -------------------------------------------------------------

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")


def dotted(path: str) -> tuple[str, ...]:
    """``a.b`` as segments, each an ASCII identifier of at most 63 bytes."""
    parts = tuple(path.split("."))
    if not all(IDENTIFIER.fullmatch(p) for p in parts):
        raise ConfigError(f"{path!r} is no dotted path; use key() for other keys")
    return parts


@dataclass(frozen=True)
class JsonRef:
    """A place in a JSON column; keys are literal, there are no array steps."""

    field: str
    path: tuple[str, ...] = ()

    def key(self, name: str) -> JsonRef:
        return JsonRef(self.field, (*self.path, name))

    def at(self, path: str) -> JsonRef:
        """The place of a dotted path from the root."""
        return JsonRef(self.field, dotted(path))

    def segments(self, *names: str) -> JsonRef:
        return JsonRef(self.field, (*self.path, *names))

    def _is(self, op: str, operand: Any = None, kind: str = "") -> JsonPredicate:
        return JsonPredicate(self.field, self.path, op, operand, kind)

    def exists(self):
        return self._is("exists")

    def missing(self):
        return self._is("missing")

    def is_json_null(self):
        return self._is("is_type", "null")

    def is_not_json_null(self):
        return self._is("is_not_json_null")

    def is_type(self, kind: str):
        if kind not in KINDS:
            raise ConfigError(f"kinds are {', '.join(KINDS)}")
        return self._is("is_type", kind)

    def is_bool(self):
        return self.is_type("bool")

    def is_number(self):
        return self.is_type("number")

    def is_string(self):
        return self.is_type("string")

    def is_array(self):
        return self.is_type("array")

    def is_object(self):
        return self.is_type("object")

    def has_key(self, k: str):
        return self._is("has_all_keys", (k,))

    def has_any_key(self, ks):
        return self._is("has_any_key", tuple(ks))

    def has_all_keys(self, ks):
        return self._is("has_all_keys", tuple(ks))

    def value(self, kind: str) -> JsonScalar:
        """A typed scalar view: bool, number (also i64, u64, f64) or string."""
        kind = {"i64": "number", "u64": "number", "f64": "number"}.get(kind, kind)
        if kind not in ("bool", "number", "string"):
            raise ConfigError("scalars are bool, number or string")
        return JsonScalar(self, kind)

    def eq_json(self, doc):
        return self._is("eq_json", Frozen(check_value(doc)))

    def neq_json(self, doc):
        return self._is("neq_json", Frozen(check_value(doc)))

    def array_contains(self, element):
        return self._is("array_contains", Frozen(check_value(element)))

    def array_len_eq(self, n: int):
        return self._is("len_eq", n)

    def array_len_gt(self, n: int):
        return self._is("len_gt", n)

    def array_len_gte(self, n: int):
        return self._is("len_gte", n)

    def array_len_lt(self, n: int):
        return self._is("len_lt", n)

    def array_len_lte(self, n: int):
        return self._is("len_lte", n)


@dataclass(frozen=True)
class Frozen:
    """A JSON value inside a predicate."""

    value: Any

    def __hash__(self):
        return hash(json.dumps(self.value, sort_keys=True))


@dataclass(frozen=True)
class JsonScalar:
    ref: JsonRef
    kind: str

    def _is(self, op: str, operand) -> JsonPredicate:
        for v in operand if isinstance(operand, tuple) else (operand,):
            if kind_of(check_value(v)) != self.kind:
                raise JsonValueError(f"{v!r} is no {self.kind}")
        return self.ref._is(op, operand, self.kind)

    def _ordered(self, op: str, operand) -> JsonPredicate:
        if self.kind != "number":
            raise ConfigError("only numbers are ordered")
        return self._is(op, operand)

    def eq(self, v):
        return self._is("eq", v)

    def neq(self, v):
        return self._is("neq", v)

    def in_(self, vs):
        return self._is("in", tuple(vs))

    def not_in(self, vs):
        return self._is("not_in", tuple(vs))

    def gt(self, v):
        return self._ordered("gt", v)

    def gte(self, v):
        return self._ordered("gte", v)

    def lt(self, v):
        return self._ordered("lt", v)

    def lte(self, v):
        return self._ordered("lte", v)

    def between(self, low, high):
        return self._ordered("between", (low, high))


COMPARE = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


@dataclass(frozen=True)
class JsonPredicate(Predicate):
    """One test at one place; a missing or mismatched value fails all tests
    but ``missing``, negated ones too."""

    field: str
    path: tuple[str, ...]
    op: str
    operand: Any = None
    kind: str = ""

    def leaves(self):
        yield self

    def evaluate(self, row: dict) -> bool:
        """For a row whose JSON columns hold Python values (MISSING for null)."""
        x = row[self.field]
        x = MISSING if x is MISSING else resolve(x, self.path)
        v = self.operand.value if isinstance(self.operand, Frozen) else self.operand
        if x is MISSING or self.op == "missing":
            return x is MISSING and self.op == "missing"
        if self.kind and kind_of(x) != self.kind:
            return False
        match self.op:
            case "exists":
                return True
            case "is_not_json_null":
                return x is not None
            case "is_type":
                return kind_of(x) == v
            case "has_any_key":
                return isinstance(x, dict) and any(k in x for k in v)
            case "has_all_keys":
                return isinstance(x, dict) and all(k in x for k in v)
            case "in":
                return any(x == e for e in v)
            case "not_in":
                return not any(x == e for e in v)
            case "between":
                return v[0] <= x <= v[1]
            case "eq_json":
                return deep_equal(x, v)
            case "neq_json":
                return not deep_equal(x, v)
            case "array_contains":
                return isinstance(x, list) and any(deep_equal(e, v) for e in x)
        if self.op.startswith("len_"):
            return isinstance(x, list) and COMPARE[self.op[4:]](len(x), v)
        return COMPARE[self.op](x, v)

    def lower(self) -> Column:
        return _lower(self, place(F.col(f"`{self.field}`"), self.path))


# --- lowering to variant columns ----------------------------------------------

VARIANTS = "array<variant>"


def place(c: Column, path: tuple[str, ...]) -> Column:
    """The variant at a path; null where it is missing."""
    for key in path:
        if '"' not in key and "\\" not in key:
            c = F.try_variant_get(c, f'$["{key}"]', "variant")
        elif "'" not in key and "\\" not in key:
            c = F.try_variant_get(c, f"$['{key}']", "variant")
        else:
            c = F.when(is_kind(c, "object"), F.try_element_at(F.try_variant_get(c, "$", "map<string,variant>"), F.lit(key)))
    return c


# How Spark names the schema of a variant of each kind.
SCHEMAS = {"null": "^VOID$", "bool": "^BOOLEAN$", "number": r"^(BIGINT|DOUBLE|DECIMAL)", "string": "^STRING$", "array": "^ARRAY<", "object": "^OBJECT<"}


def is_kind(x: Column, kind: str) -> Column:
    return F.regexp_like(F.schema_of_variant(x), F.lit(SCHEMAS[kind]))


def _is_integer(x: Column) -> Column:
    """Carried as an integer: fractional text gives a decimal of other form."""
    return F.regexp_like(F.schema_of_variant(x), F.lit(r"^(BIGINT|DECIMAL\((19|20),0\))$"))


def _number_test(x: Column, op: str, v: int | float) -> Column:
    """x ``op`` v in exact arithmetic; v is finite."""
    whole, real = F.try_variant_get(x, "$", "decimal(20,0)"), F.try_variant_get(x, "$", "double")
    tests = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    above = {"eq": False, "neq": True, "gt": True, "gte": True, "lt": False, "lte": False}  # where x > v, never equal
    floor = math.floor(v)
    exact = floor == v
    if exact and I64 <= floor <= U64:
        integers = tests[op](whole, F.lit(str(floor)).cast("decimal(20,0)"))
    elif I64 <= floor <= U64:  # v lies between floor and floor + 1
        up = whole > F.lit(str(floor)).cast("decimal(20,0)")
        integers = F.when(up, F.lit(above[op])).otherwise(F.lit(not above[op] if op not in ("eq", "neq") else op == "neq"))
    else:
        integers = F.lit(COMPARE[op](0, v))
    near = float(v)
    if near == v:
        reals = tests[op](real, F.lit(near))
    else:  # v is an integer that no double equals
        up = real >= F.lit(near) if near > v else real > F.lit(near)
        reals = F.when(up, F.lit(above[op])).otherwise(F.lit(op in ("neq", "lt", "lte")))
    return F.when(_is_integer(x), integers).otherwise(reals)


def _scalar_test(x: Column, kind: str, op: str, v) -> Column:
    if kind == "number":
        return _number_test(x, op, v)
    c = F.try_variant_get(x, "$", "boolean" if kind == "bool" else "string")
    return (c == F.lit(v)) if op == "eq" else (c != F.lit(v))


def equals(x: Column, doc: Any) -> Column:
    """Deep equality with a literal, compiled to tests of its parts."""
    kind = kind_of(doc)
    test = is_kind(x, kind)
    if kind == "array":
        items = F.try_variant_get(x, "$", VARIANTS)
        parts = [F.size(items) == len(doc), *(F.coalesce(equals(F.get(items, i), v), F.lit(False)) for i, v in enumerate(doc))]
    elif kind == "object":
        parts = [F.size(F.try_variant_get(x, "$", "map<string,variant>")) == len(doc), *(F.coalesce(equals(place(x, (k,)), v), F.lit(False)) for k, v in doc.items())]
    else:
        parts = [] if doc is None else [_scalar_test(x, kind, "eq", doc)]
    return F.when(test, reduce(and_, parts, F.lit(True))).otherwise(F.lit(False))


def _lower(p: JsonPredicate, x: Column) -> Column:
    v = p.operand.value if isinstance(p.operand, Frozen) else p.operand
    if p.op == "missing":
        return x.isNull()
    if p.op == "exists":
        return x.isNotNull()
    if p.kind:
        if p.op in ("in", "not_in"):
            found = reduce(or_, (_scalar_test(x, p.kind, "eq", e) for e in v), F.lit(False))
            test = found if p.op == "in" else ~found
        elif p.op == "between":
            test = _number_test(x, "gte", v[0]) & _number_test(x, "lte", v[1])
        else:
            test = _scalar_test(x, p.kind, p.op, v)
        return F.when(is_kind(x, p.kind), test).otherwise(F.lit(False))
    if p.op == "is_not_json_null":
        return x.isNotNull() & ~F.is_variant_null(x)
    if p.op == "is_type":
        return is_kind(x, v)
    if p.op in ("has_any_key", "has_all_keys"):
        some = [place(x, (k,)).isNotNull() for k in v]
        return is_kind(x, "object") & (reduce(or_, some, F.lit(False)) if p.op == "has_any_key" else reduce(and_, some, F.lit(True)))
    if p.op in ("eq_json", "neq_json"):
        return x.isNotNull() & (equals(x, v) if p.op == "eq_json" else ~equals(x, v))
    items = F.try_variant_get(x, "$", VARIANTS)
    if p.op == "array_contains":
        return is_kind(x, "array") & F.exists(items, lambda e: F.coalesce(equals(e, v), F.lit(False)))
    return is_kind(x, "array") & COMPARE[p.op[4:]](F.size(items), F.lit(v))


def compare_exactly(i: Column, d: Column) -> Column:
    """-1, 0 or 1 for an integer column (decimal(20,0)) against a finite double,
    without rounding either."""
    top, half = F.lit(18446744073709551616.0), F.lit(9223372036854775808.0)
    floor = F.floor(d)
    high = F.sign(i - ((d - half).cast("bigint").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)"))).cast("int")
    low = F.sign(i - floor.cast("decimal(20,0)")).cast("int")
    return (F.when(d >= top, -1).when(d < -half, 1).when(d >= half, high)
            .when(i != floor.cast("decimal(20,0)"), low).when(floor.cast("double") == d, 0).otherwise(-1))


def as_variant(c: Column) -> Column:
    """JSON text as a variant; of a repeated key the last value counts, for which
    the session's spark.sql.variant.allowDuplicateKeys is set from now on.
    Malformed text is null."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.variant.allowDuplicateKeys", True)
    return F.try_parse_json(c)


def as_json(c: Column) -> Column:
    """A variant as JSON text, or null."""
    return F.to_json(c)
