"""What a delta subscription knows of its ids: the members it brought in and,
of these, the evicted ones that it is to ask for again.

``Listed`` keeps them in the driver, as pools do that are held there.  ``Filed``
is for pools kept as tables: fetched rows, members and queue are files under the
pool's folder, and only counts and cursors reach the driver.
"""

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from poolwright.operators import merge as m
from poolwright.operators.pool import Pool
from poolwright.sources.versions import ORDER

PLACE = "_place"


@dataclass
class Batch:
    """What a tick fetched; ``seq`` tells the last of repeated ids, if the
    items are no list."""

    items: list | DataFrame
    dead: list | DataFrame
    seq: Column | None
    cursor: Any


class Listed:
    def __init__(self, pool: Pool):
        self._pool = pool
        self.members: set[tuple] = set()
        self._queue: dict[tuple, tuple[int, int]] = {}  # id: attempts, tick from which it may be asked for

    @property
    def pending(self) -> int:
        return len(self._queue)

    def observe(self, first: int, last: int) -> None:
        """Queue the members that these events evicted."""
        for e in self._pool.store.events(first, last):
            id = self._pool._key(e)
            if e["reason"] == m.LRU_EVICT and id in self.members:
                self._queue.setdefault(id, (0, 0))

    def take(self, tick: int | None) -> dict:
        """From the queue, what may be asked for in a tick; all, if None."""
        asked = {i: x for i, x in self._queue.items() if tick is None or x[1] <= tick}
        for i in asked:
            del self._queue[i]
        return asked

    def ids(self, asked: dict) -> list:
        return [i if len(i) > 1 else i[0] for i in asked]

    def stage(self, result, since: Any) -> Batch:
        """What was fetched, and the cursor after it."""
        pool, keys = self._pool, self._pool.model.keys
        items = [r.asDict() for r in result.items.collect()] if isinstance(result.items, DataFrame) else list(result.items)
        dead = [tuple(r) if len(keys) > 1 else r[0] for r in result.tombstones.select(*keys).collect()] if isinstance(result.tombstones, DataFrame) else list(result.tombstones)
        cursors = [r[pool.model.watermark] for r in items if r[pool.model.watermark] is not None]
        seen = [x for x in (since, result.high_watermark, *cursors) if x is not None]
        return Batch(items, dead, None, max(seen) if seen else None)

    def mark(self) -> Any:
        return set(self.members), dict(self._queue)

    def adopt(self, batch: Batch, asked: dict, *, full: bool) -> None:
        """The members after a batch: what it brings and, unless it is a full
        one, those before but for ids that were asked for and did not come."""
        got, dead = {self._pool._key(r) for r in batch.items}, {self._pool._id(i) for i in batch.dead}
        self.members = (got - dead) if full else (self.members | got) - dead - (set(asked) - got)

    def keep(self, mark: Any, asked: dict) -> None:
        """A tick is done."""

    def undo(self, mark: Any, asked: dict, tick: int) -> None:
        """A tick failed: all is as at ``mark``, and what was asked for waits."""
        self.members, self._queue = mark
        for i, (attempts, _) in asked.items():
            self._queue[i] = (attempts + 1, later(tick, attempts))

    def clear(self) -> None:
        """Drop what only the tick needed."""


@dataclass(frozen=True)
class Part:
    """Ids that were evicted between two looks: they wait together."""

    path: str
    n: int
    attempts: int = 0
    due: int = 0


class Filed:
    def __init__(self, pool: Pool):
        self._pool, self._root = pool, f"{pool.store.root}/subscriptions/{uuid.uuid4().hex}"
        self._ids = T.StructType([pool.model.schema[k] for k in pool.model.keys])
        self._members: str | None = None
        self._queue: list[Part] = []
        self._staged: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        path = f"{self._root}/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
        except BaseException:
            self._pool.store._delete(path)
            raise
        return path

    def _read(self, *paths: str) -> DataFrame:
        spark = self._pool.spark
        return spark.read.schema(self._ids).parquet(*paths) if paths else spark.createDataFrame([], self._ids)

    @property
    def members(self) -> DataFrame:
        """The key columns; to be read before the next tick."""
        return self._read(*([self._members] if self._members else []))

    @property
    def pending(self) -> int:
        return sum(p.n for p in self._queue)

    def observe(self, first: int, last: int) -> None:
        if first >= last or self._members is None:
            return
        keys = self._pool.model.keys
        told = self._pool.store.changelog().where((F.col(ORDER) >= first) & (F.col(ORDER) < last) & (F.col("reason") == m.LRU_EVICT)).select(*keys)
        if told.isEmpty():
            return
        new = told.distinct().alias("e").join(self.members.alias("m"), m._on(keys, "e", "m"), "left_semi")
        if self._queue:
            new = new.alias("e").join(self.ids(self._queue).alias("q"), m._on(keys, "e", "q"), "left_anti")
        path = self._write(new)
        if n := self._read(path).count():
            self._queue.append(Part(path, n))
        else:
            self._pool.store._delete(path)

    def take(self, tick: int | None) -> list[Part]:
        asked = [p for p in self._queue if tick is None or p.due <= tick]
        self._queue = [p for p in self._queue if p not in asked]
        return asked

    def ids(self, asked: list[Part]) -> DataFrame | list:
        return self._read(*(p.path for p in asked)) if asked else []

    def stage(self, result, since: Any) -> Batch:
        """What was fetched, written once: all that follows sees the same rows,
        and of repeated ids the last in the order of the fetched ones counts."""
        pool = self._pool
        rows = pool._rows(result.items).withColumn(PLACE, F.monotonically_increasing_id())
        self._staged.append(self._write(rows))
        items, dead = pool.spark.read.schema(rows.schema).parquet(self._staged[-1]), result.tombstones
        if isinstance(dead, DataFrame):
            self._staged.append(self._write(dead.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in self._ids))))
            dead = self._read(self._staged[-1])
        else:
            dead = list(dead)
        return Batch(items, dead, F.col(PLACE), m.max_cursor(items, pool.model.watermark, explicit=result.high_watermark, since=since))

    def mark(self) -> Any:
        return self._members, list(self._queue)

    def adopt(self, batch: Batch, asked: list[Part], *, full: bool) -> None:
        keys = self._pool.model.keys
        sides = {"item": batch.items, "dead": self._pool._ids(batch.dead)}
        if not full:
            sides |= {"member": self.members, "asked": self._read(*(p.path for p in asked))}
        told = None
        for kind, rows in sides.items():
            side = rows.select(*(F.col(f"`{k}`") for k in keys), F.lit(kind).alias("_kind"))
            told = side if told is None else told.union(side)
        has = lambda kind: F.bool_or(F.col("_kind") == kind)
        known = told.groupBy(*keys).agg(has("item").alias("_item"), has("dead").alias("_dead"), has("member").alias("_member"), has("asked").alias("_asked"))
        self._members = self._write(known.where("not _dead and (_item or (_member and not _asked))").select(*keys))

    def keep(self, mark: Any, asked: list[Part]) -> None:
        for path in (mark[0], *(p.path for p in asked)):
            if path is not None:
                self._pool.store._delete(path)

    def undo(self, mark: Any, asked: list[Part], tick: int) -> None:
        new, (self._members, self._queue) = self._members, mark
        self._queue += [Part(p.path, p.n, p.attempts + 1, later(tick, p.attempts)) for p in asked]
        if new != self._members:
            self._pool.store._delete(new)

    def clear(self) -> None:
        while self._staged:
            self._pool.store._delete(self._staged.pop())


def later(tick: int, attempts: int) -> int:
    """From which tick on ids are asked for again after a failure."""
    return tick + 2 ** min(attempts, 6)
