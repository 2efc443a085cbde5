"""The ordered pipeline: lazily chained steps over rows in an explicit order.

A step maps an ordered sequence, duplicates allowed, to another.  Order is
carried in columns ``_o0, _o1, ...``; a step that keeps it costs nothing, and
only ``take``, ``skip`` and the terminals sort.  Steps run in the order given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cmp_to_key
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql import types as T

from poolwright.functions.lower import condition, total
from poolwright.functions.predicate import Predicate, as_predicate

Rows = DataFrame
Step = Callable[["Ordered"], "Ordered"]


class Ordered:
    """Rows with their order columns."""

    def __init__(self, df: DataFrame, columns: list[str], depth: int):
        self.df, self.columns, self.depth = df, columns, depth

    @property
    def order(self) -> list[Column]:
        return [F.col(f"_o{i}").asc_nulls_first() for i in range(self.depth)]

    def place(self) -> Column:
        return F.struct(*(F.col(f"_o{i}") for i in range(self.depth)))

    def select(self, order: list[Column], columns: list[Column] | None = None) -> Ordered:
        columns = [F.col(f"`{c}`") for c in self.columns] if columns is None else columns
        return Ordered(self.df.select(*columns, *(c.alias(f"_o{i}") for i, c in enumerate(order))), self.columns, len(order))

    def olds(self) -> list[Column]:
        return [F.col(f"_o{i}") for i in range(self.depth)]


def _columns(keys) -> list[Column]:
    return [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]


def _truth(p) -> tuple[Column, Column]:
    """The filter form and the total form of a predicate or boolean column."""
    return (p, F.coalesce(p, F.lit(False))) if isinstance(p, Column) else (condition(as_predicate(p)), total(as_predicate(p)))


def guarded(test: Callable[[dict], bool], columns: list[str]) -> Column:
    """An opaque test of a row; a row on which it raises does not match."""

    def run(row: Row) -> bool:
        try:
            return bool(test(row.asDict(recursive=True)))
        except Exception:  # noqa: BLE001  the closure is the user's
            return False

    return F.udf(run, "boolean")(F.struct(*(F.col(f"`{c}`") for c in columns)))


def _by_rows(o: Ordered, of: Callable[[dict], Iterable[dict]]) -> Ordered:
    """Each row replaced by the rows that an opaque function makes of it."""
    columns, depth, schema = o.columns, o.depth, o.df.schema
    out = T.StructType([*schema.fields, T.StructField(f"_o{depth}", T.LongType())])
    target = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                rest = {k: v for k, v in row.items() if k not in columns}
                rows += [{**rest, **{c: made[c] for c in columns}, f"_o{depth}": i} for i, made in enumerate(of({c: row[c] for c in columns}))]
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return Ordered(o.df.mapInArrow(run, out), columns, depth + 1)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --- steps ------------------------------------------------------------------

def filter_(p: Predicate | Column) -> Step:
    return lambda o: Ordered(o.df.where(_truth(p)[0]), o.columns, o.depth)


def filter_closure(test: Callable[[dict], bool]) -> Step:
    return lambda o: Ordered(o.df.where(guarded(test, o.columns)), o.columns, o.depth)


def map_(**changes: Column) -> Step:
    """The same row type with some columns computed anew."""
    return lambda o: o.select(o.olds(), [(changes[c].cast(o.df.schema[c].dataType) if c in changes else F.col(f"`{c}`")).alias(c) for c in o.columns])


def map_rows(of: Callable[[dict], dict]) -> Step:
    return lambda o: _by_rows(o, lambda row: [of(row)])


def flat_map(*rows: dict[str, Column]) -> Step:
    """One row for each of ``rows``, in turn; a dict gives the columns that
    differ, and may have a boolean under ``_when``."""

    def run(o: Ordered) -> Ordered:
        row = lambda r: F.struct(*((r[c].cast(o.df.schema[c].dataType) if c in r else F.col(f"`{c}`")).alias(c) for c in o.columns))
        made = F.array(*(F.when(F.coalesce(r.get("_when", F.lit(True)), F.lit(False)), F.struct(F.lit(i).cast("long").alias("i"), row(r).alias("r"))) for i, r in enumerate(rows)))
        df = o.df.select(*o.olds(), F.explode(made).alias("_m")).where("_m is not null")
        return Ordered(df.select(*(F.col(f"_m.r.`{c}`").alias(c) for c in o.columns), *o.olds(), F.col("_m.i").alias(f"_o{o.depth}")), o.columns, o.depth + 1)

    return run


def flat_map_rows(of: Callable[[dict], Iterable[dict]]) -> Step:
    return lambda o: _by_rows(o, of)


def take(n: int) -> Step:
    return Slice(0, n)


def skip(n: int) -> Step:
    """All but the first ``n`` rows.  With a ``take`` next to it both are one
    top-n; alone, one task counts the rows off after a sort."""
    return Slice(n, None)


class Slice:
    """The rows from place ``first`` on, ``many`` of them or all."""

    def __init__(self, first: int, many: int | None):
        self.first, self.many = first, many

    def __call__(self, o: Ordered) -> Ordered:
        rows = o.df.orderBy(*o.order)
        rows = rows if self.many is None else rows.limit(self.first + self.many)
        return Ordered(rows.offset(self.first) if self.first else rows, o.columns, o.depth)

    def then(self, other: Slice) -> Slice:
        left = None if self.many is None else max(0, self.many - other.first)
        many = left if other.many is None else other.many if left is None else min(left, other.many)
        return Slice(self.first + other.first, many)


def _joined(steps: Iterable[Step]) -> list[Step]:
    """The steps, slices that follow each other as one."""
    out: list[Step] = []
    for step in steps:
        both = out and isinstance(out[-1], Slice) and isinstance(step, Slice)
        out[-1:] = [out[-1].then(step)] if both else [*out[-1:], step]
    return out


def chain(rows: DataFrame | Iterable[dict]) -> Step:
    """Rows after all others; a list of them keeps its order, a DataFrame is
    taken in the order of its columns."""

    def run(o: Ordered) -> Ordered:
        schema = T.StructType([o.df.schema[c] for c in o.columns])
        if isinstance(rows, DataFrame):
            more = rows.select(*(F.col(f"`{c}`").cast(schema[c].dataType) for c in o.columns)).withColumn("_n", F.struct(*(F.col(f"`{c}`") for c in o.columns if not isinstance(schema[c].dataType, (T.MapType, T.VariantType)))))
        else:
            listed = [(*(r[c] for c in o.columns), i) for i, r in enumerate(rows)]
            more = o.df.sparkSession.createDataFrame(listed, T.StructType([*schema.fields, T.StructField("_n", T.LongType())]))
        left = o.select([F.lit(0), *o.olds(), F.lit(None).cast(more.schema["_n"].dataType)])
        blank = [F.lit(None).cast(o.df.schema[f"_o{i}"].dataType) for i in range(o.depth)]
        right = Ordered(more, o.columns, 0).select([F.lit(1), *blank, F.col("_n")])
        return Ordered(left.df.unionByName(right.df), o.columns, left.depth)

    return run


def sort_by_key(*keys: str | Column) -> Step:
    """Ascending, null first, stable."""
    return lambda o: o.select([*_columns(keys), *o.olds()])


def sort(compare: Callable[[dict, dict], int]) -> Step:
    """By an opaque comparison, stable.  The comparison needs all rows in one
    task: use ``sort_by_key`` wherever a key exists."""

    def run(o: Ordered) -> Ordered:
        return _in_one_task(o, lambda rows: sorted(rows, key=cmp_to_key(compare)))

    return run


def unique_by(*keys: str | Column) -> Step:
    """The first row of each key, order kept."""

    def run(o: Ordered) -> Ordered:
        rank = F.row_number().over(Window.partitionBy(*_columns(keys)).orderBy(*o.order))
        return Ordered(o.df.withColumn("_rank", rank).where("_rank = 1").drop("_rank"), o.columns, o.depth)

    return run


def group_by(*keys: str | Column) -> Step:
    """Rows of a key together, keys in the order of their first rows: nothing
    is aggregated.  The first places are found by a partial aggregation."""

    def run(o: Ordered) -> Ordered:
        named = {f"_k{i}": k for i, k in enumerate(_columns(keys))}
        df = o.df.withColumns(named)
        # A struct of order columns compares as they do, null first.
        first = df.groupBy(*named).agg(F.min(o.place()).alias("_first"))
        on = None
        first = first.select(*(F.col(k).alias(f"{k}x") for k in named), "_first")
        for k in named:
            same = F.col(k).eqNullSafe(F.col(f"{k}x"))
            on = same if on is None else on & same
        return Ordered(df.join(first, on), o.columns, o.depth).select([F.col("_first"), *o.olds()])

    return run


def partition(p: Predicate | Column | Callable[[dict], bool]) -> Step:
    """Rows that match, then the others, each in the old order."""

    def run(o: Ordered) -> Ordered:
        test = guarded(p, o.columns) if callable(p) and not isinstance(p, (Column, Predicate)) else _truth(p)[1]
        return o.select([~test, *o.olds()])

    return run


def fold_max(key: str | Column, *, last: bool = True) -> Step:
    """The row with the greatest key, the last (first) of equal ones."""
    return _fold_extreme(key, last, F.col("_key").desc_nulls_last())


def fold_min(key: str | Column, *, last: bool = False) -> Step:
    """The row with the least key, the first (last) of equal ones."""
    return _fold_extreme(key, last, F.col("_key").asc_nulls_first())


def _fold_extreme(key: str | Column, last: bool, by: Column) -> Step:
    def run(o: Ordered) -> Ordered:
        turn = [F.col(f"_o{i}").desc_nulls_last() for i in range(o.depth)] if last else o.order
        return Ordered(o.df.withColumn("_key", _columns([key])[0]).orderBy(by, *turn).limit(1).drop("_key"), o.columns, o.depth)

    return run


def fold_aggregate(**aggregates: Column) -> Step:
    """One row of aggregates, a column not named is the first row's; none if
    there are no rows."""

    def run(o: Ordered) -> Ordered:
        row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in o.columns)), o.place()).alias("_row")
        one = o.df.agg(F.count("*").alias("_n"), row, *(a.alias(f"_a{i}") for i, a in enumerate(aggregates.values()))).where("_n > 0")
        at = {c: f"_a{i}" for i, c in enumerate(aggregates)}
        return Ordered(one, o.columns, 0).select([F.lit(0)], [(F.col(at[c]).cast(o.df.schema[c].dataType) if c in at else F.col(f"_row.`{c}`")).alias(c) for c in o.columns])

    return run


def fold_rows(of: Callable[[list[dict]], dict | None]) -> Step:
    """An opaque function of all rows that makes one row or none.  It needs
    all rows in one task: use an aggregate wherever one exists."""

    def run(o: Ordered) -> Ordered:
        def one(rows: list[dict]) -> list[dict]:
            made = of(rows)
            return [] if made is None else [made]

        return _in_one_task(o, one)

    return run


def _in_one_task(o: Ordered, of: Callable[[list[dict]], list[dict]]) -> Ordered:
    columns = o.columns
    schema = T.StructType([*(o.df.schema[c] for c in columns), T.StructField("_o0", T.LongType())])
    target = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [{c: r[c] for c in columns} for batch in batches for r in batch.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_pylist([{**r, "_o0": i} for i, r in enumerate(of(rows))], schema=target)

    return Ordered(o.df.repartition(1).sortWithinPartitions(*o.order).mapInArrow(run, schema), columns, 1)


# --- the query handle ----------------------------------------------------------

class Scope:
    """A lazy query over rows: ``source`` gives them, with system columns or
    not, when a terminal runs; ``keys`` give the first order."""

    def __init__(self, source: Callable[[], DataFrame] | DataFrame, keys: tuple[str, ...], steps: tuple[Step, ...] = ()):
        self._source = (lambda: source) if isinstance(source, DataFrame) else source
        self._keys, self._steps = keys, steps

    def then(self, step: Step | Predicate) -> Scope:
        step = filter_(step) if isinstance(step, Predicate) or hasattr(step, "__as_predicate__") else step
        return Scope(self._source, self._keys, (*self._steps, step))

    def filter(self, p: Predicate | Column | Callable[[dict], bool]) -> Scope:
        if callable(p) and not isinstance(p, (Predicate, Column)) and not hasattr(p, "__as_predicate__"):
            return self.then(filter_closure(p))
        return self.then(filter_(p))

    def filter_closure(self, test: Callable[[dict], bool]) -> Scope:
        return self.then(filter_closure(test))

    def map(self, of: Callable[[dict], dict] | None = None, **changes: Column) -> Scope:
        return self.then(map_rows(of) if of else map_(**changes))

    def flat_map(self, *rows: dict[str, Column] | Callable[[dict], Iterable[dict]]) -> Scope:
        return self.then(flat_map_rows(rows[0]) if len(rows) == 1 and callable(rows[0]) else flat_map(*rows))

    def take(self, n: int) -> Scope:
        return self.then(take(n))

    def skip(self, n: int) -> Scope:
        return self.then(skip(n))

    def chain(self, rows: DataFrame | Iterable[dict]) -> Scope:
        return self.then(chain(rows))

    def sort(self, compare: Callable[[dict, dict], int]) -> Scope:
        return self.then(sort(compare))

    def sort_by_key(self, *keys: str | Column) -> Scope:
        return self.then(sort_by_key(*keys))

    def unique(self) -> Scope:
        return self.then(unique_by(*self._keys))

    def unique_by(self, *keys: str | Column) -> Scope:
        return self.then(unique_by(*keys))

    def group_by(self, *keys: str | Column) -> Scope:
        return self.then(group_by(*keys))

    def partition(self, p) -> Scope:
        return self.then(partition(p))

    def fold(self, of: Callable[[list[dict]], dict | None] | None = None, **aggregates: Column) -> Scope:
        return self.then(fold_rows(of) if of else fold_aggregate(**aggregates))

    def fold_max(self, key: str | Column, *, last: bool = True) -> Scope:
        return self.then(fold_max(key, last=last))

    def fold_min(self, key: str | Column, *, last: bool = False) -> Scope:
        return self.then(fold_min(key, last=last))

    # terminals

    def ordered(self) -> Ordered:
        df = self._source()
        columns = [c for c in df.columns if not c.startswith("_")]
        out = Ordered(df, columns, 0).select([F.col(f"`{k}`") for k in self._keys])
        for step in _joined(self._steps):
            out = step(out)
        return out

    def rows(self) -> DataFrame:
        """The result without its order: nothing is sorted for it."""
        o = self.ordered()
        return o.df.select(*(f"`{c}`" for c in o.columns))

    def dataframe(self) -> DataFrame:
        """The result in its order."""
        o = self.ordered()
        return o.df.orderBy(*o.order).select(*(f"`{c}`" for c in o.columns))

    def numbered(self, name: str = "pos") -> DataFrame:
        """The result with each row's place from 0: a range sort deals rows to
        partitions in order, and each adds the sizes of those before it."""
        o = self.ordered()
        df = o.df.orderBy(*o.order).select(*(f"`{c}`" for c in o.columns))
        schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
        numbered = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
        return df.sparkSession.createDataFrame(numbered, schema)

    def collect(self) -> list[Row]:
        return self.dataframe().collect()

    def iter(self) -> Iterator[Row]:
        return self.dataframe().toLocalIterator()

    def first(self) -> Row | None:
        found = self.take(1).collect()
        return found[0] if found else None

    def count(self) -> int:
        return self.rows().count()

    def exists(self) -> bool:
        return not self.rows().isEmpty()
