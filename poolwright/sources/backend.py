"""Second-level stores of pools: the interface, two stores, the policy for
failures, and the keyspace.

A store works on DataFrames of rows with ``_expires_at``, one keyspace for each
namespace and model.
"""

import random
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwright.errors import BackendError, ConfigError, NotConfigured
from poolwright.schema import Model

# Failure modes.
L1_ONLY, ERROR, RETRY = "l1_only", "error", "retry"


def hexed(text: str) -> str:
    return text.encode().hex()


def hex_key(c: Column) -> Column:
    """Lower-case hex of the UTF-8 text of a key part."""
    return F.lower(F.hex(F.encode(c.cast("string"), "UTF-8")))


def keyspace(namespace: str | None, model: str) -> str:
    """A path that no other pair of namespace and model shares."""
    return f"{'ns_' + hexed(namespace) if namespace is not None else 'default'}/ty_{hexed(model)}"


@dataclass(frozen=True)
class Invalidation:
    """One id, or all of a keyspace if ``id`` is None."""

    id: tuple | None


class Backend(ABC):
    """A store.  Reads give live rows only; writes replace rows of equal keys."""

    @abstractmethod
    def get(self, model: Model, namespace: str | None, ids: DataFrame, now: datetime) -> DataFrame:
        """Live rows of the keys in ``ids``, with ``_expires_at``."""

    @abstractmethod
    def put(self, model: Model, namespace: str | None, rows: DataFrame, now: datetime) -> None: ...

    @abstractmethod
    def invalidate(self, model: Model, namespace: str | None, ids: DataFrame) -> None: ...

    @abstractmethod
    def invalidate_all(self, model: Model, namespace: str | None) -> None: ...

    def invalidations(self) -> Iterator[Invalidation] | None:
        """A stream of what others invalidated; None if the store has none."""
        return None


def _same(model: Model):
    on = F.lit(True)
    for k in model.keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on


class MemoryBackend(Backend):
    """Rows held by the session's plans; for tests and single programs."""

    def __init__(self):
        self._rows: dict[str, DataFrame] = {}

    def _all(self, model: Model, namespace: str | None) -> DataFrame | None:
        return self._rows.get(keyspace(namespace, model.name))

    def get(self, model, namespace, ids, now):
        rows = self._all(model, namespace)
        if rows is None:
            return ids.sparkSession.createDataFrame([], model.schema).withColumn("_expires_at", F.lit(None).cast("timestamp"))
        alive = F.col("_expires_at").isNull() | (F.col("_expires_at") > F.lit(now))
        return rows.where(alive).alias("a").join(ids.select(*model.keys).distinct().alias("b"), _same(model), "left_semi")

    def _store(self, model, namespace, rows: DataFrame) -> None:
        held = rows.collect()  # this store lives in the driver
        self._rows[keyspace(namespace, model.name)] = rows.sparkSession.createDataFrame(held, rows.schema)

    def put(self, model, namespace, rows, now):
        rows = rows.select(*model.columns(), "_expires_at")
        old = self._all(model, namespace)
        if old is not None:
            rows = old.alias("a").join(rows.alias("b"), _same(model), "left_anti").unionByName(rows)
        self._store(model, namespace, rows)

    def invalidate(self, model, namespace, ids):
        old = self._all(model, namespace)
        if old is not None:
            self._store(model, namespace, old.alias("a").join(ids.alias("b"), _same(model), "left_anti"))

    def invalidate_all(self, model, namespace):
        self._rows.pop(keyspace(namespace, model.name), None)


class ParquetBackend(Backend):
    """A folder for each keyspace with versions of it.  A version is written
    whole under its own name and then named by a numbered pointer file, which
    appears by a rename; the greatest number is the current one, so readers see
    the old version or the new one.  The last ``KEEP`` stay for readers that
    hold them.  Of two writers of one number the later one fails."""

    KEEP = 3

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _space(self, model: Model, namespace: str | None) -> str:
        return f"{self.root}/{keyspace(namespace, model.name)}"

    def _current(self, space: str) -> str | None:
        found = self._pointers(space)
        return self.spark.read.text(f"{space}/pointers/{found[-1]}").first()[0] if found else None

    def _pointers(self, space: str) -> list[str]:
        fs, folder = self._fs(f"{space}/pointers")
        return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []

    def _publish(self, space: str, rows: DataFrame) -> None:
        version, held = uuid.uuid4().hex, self._pointers(space)
        rows.write.parquet(f"{space}/{version}")
        fs, made = self._fs(f"{space}/CURRENT.{version}")
        out = fs.create(made)
        out.write(bytearray(version.encode()))
        out.close()
        pointer = self._fs(f"{space}/pointers/{int(held[-1]) + 1 if held else 1:012d}")[1]
        fs.mkdirs(pointer.getParent())
        if fs.exists(pointer) or not fs.rename(made, pointer):
            raise BackendError(f"another writer has published {space}")
        for name in held[: 1 - self.KEEP]:
            gone = self.spark.read.text(f"{space}/pointers/{name}").first()[0]
            fs.delete(self._fs(f"{space}/pointers/{name}")[1], True)
            fs.delete(self._fs(f"{space}/{gone}")[1], True)

    def _read(self, model: Model, namespace: str | None) -> DataFrame:
        space = self._space(model, namespace)
        version = self._current(space)
        empty = self.spark.createDataFrame([], model.schema).withColumn("_expires_at", F.lit(None).cast("timestamp"))
        return empty if version is None else self.spark.read.schema(empty.schema).parquet(f"{space}/{version}")

    def get(self, model, namespace, ids, now):
        alive = F.col("_expires_at").isNull() | (F.col("_expires_at") > F.lit(now))
        return self._read(model, namespace).where(alive).alias("a").join(ids.select(*model.keys).distinct().alias("b"), _same(model), "left_semi")

    def put(self, model, namespace, rows, now):
        rows = rows.select(*model.columns(), "_expires_at")
        alive = F.col("_expires_at").isNull() | (F.col("_expires_at") > F.lit(now))
        rest = self._read(model, namespace).where(alive).alias("a").join(rows.alias("b"), _same(model), "left_anti")
        self._publish(self._space(model, namespace), rest.unionByName(rows))

    def invalidate(self, model, namespace, ids):
        if self._current(self._space(model, namespace)) is not None:
            self._publish(self._space(model, namespace), self._read(model, namespace).alias("a").join(ids.alias("b"), _same(model), "left_anti"))

    def invalidate_all(self, model, namespace):
        fs, path = self._fs(self._space(model, namespace))
        fs.delete(path, True)


class RedisBackend(Backend):
    """Needs the optional package ``redis`` and a server; without them it can
    only be named."""

    def __init__(self, url: str):
        try:
            import redis  # noqa: F401
        except ImportError as e:
            raise NotConfigured("the redis package is not installed") from e
        raise NotConfigured(f"no server at {url}: this store is an interface only")

    get = put = invalidate = invalidate_all = None


@dataclass
class FailurePolicy:
    """What a failing store means: nothing (``l1_only``), an error, or up to
    ``attempts`` further tries after 25 ms, doubled up to 1 s, and some jitter."""

    mode: str = L1_ONLY
    attempts: int = 0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def __post_init__(self):
        if self.mode not in (L1_ONLY, ERROR, RETRY):
            raise ConfigError(f"no failure mode {self.mode!r}")
        if self.mode == RETRY and self.attempts < 1:
            raise ConfigError("retries are at least one")

    def run(self, call: Callable[[], object], on_error: Callable[[BackendError], None] = lambda e: None):
        """(result, error): the error is raised in mode ``error``, else kept."""
        tries = self.attempts if self.mode == RETRY else 0
        for k in range(tries + 1):
            try:
                return call(), None
            except BackendError as e:
                on_error(e)
                if self.mode == ERROR:
                    raise
                if k == tries or not e.retryable:
                    return None, e
                wait = min(1.0, 0.025 * 2**k)
                self.sleep(wait * (1 + random.random() / 4))
        return None, None
