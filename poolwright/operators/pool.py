"""Pools: an identity map of rows in versions, with one writer at a time.

Every write makes a new version of the resident rows, publishes it, and then
appends its events to the pool's change log.  Readers hold a version.  Point
operations cost a Spark job each; bulk ones are the intended use.
"""

import threading
from collections.abc import Callable, Iterable
from concurrent.futures import Future
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from poolwright.errors import BackendFailed, ConfigError, Conflict, FetcherFailed, IdentityMismatch, Reserved, SerializationFailed
from poolwright.operators import merge as m
from poolwright.operators.sequence import Scope, Step
from poolwright.schema import Model
from poolwright.sources import snapshot
from poolwright.sources.backend import ERROR, Backend, FailurePolicy
from poolwright.sources.versions import Held, Tables


class Metrics:
    """Callbacks of a pool; what they raise is ignored."""

    def hit(self, tier: str) -> None: ...

    def miss(self) -> None: ...

    def eviction(self, reason: str, n: int) -> None: ...

    def backend_error(self, error: Exception) -> None: ...

    def fetch_latency(self, seconds: float) -> None: ...

    def size(self, n: int) -> None: ...


@dataclass
class Config:
    lru_size: int = 10_000
    event_channel_capacity: int = 256
    on_conflict: str = m.LAST_WRITE_WINS
    default_ttl: timedelta | None = None
    ttl_sweep_interval: timedelta | None = None
    namespace: str | None = None
    failure: FailurePolicy = field(default_factory=FailurePolicy)
    metrics: Metrics | None = None

    def __post_init__(self):
        if self.lru_size < 1:
            raise ConfigError("lru_size is at least 1")
        if self.event_channel_capacity < 1:
            raise ConfigError("event_channel_capacity is at least 1")
        if self.on_conflict not in m.POLICIES:
            raise ConfigError(f"no conflict policy {self.on_conflict!r}")
        if self.ttl_sweep_interval is not None and self.ttl_sweep_interval <= timedelta(0):
            raise ConfigError("ttl_sweep_interval is positive")
        if self.namespace == "":
            raise ConfigError("a namespace is not empty")


class Lagged(Exception):
    """A subscriber fell behind by more events than the log keeps for it."""


class Subscription:
    """A subscriber's place in the change log."""

    def __init__(self, pool: "Pool"):
        self._pool, self._at = pool, len(pool.store)

    def poll(self) -> list[Row]:
        """Events since the last call, in order; raises Lagged once if more
        have come than the channel holds, then goes on from the oldest held."""
        store, capacity = self._pool.store, self._pool.config.event_channel_capacity
        end = len(store)
        if end - self._at > capacity:
            missed, self._at = end - self._at - capacity, end - capacity
            raise Lagged(f"{missed} events")
        out, self._at = store.events(self._at, end), end
        return out


class Pool:
    """Rows of one model, at most ``lru_size`` of them."""

    def __init__(self, spark: SparkSession, model: Model, config: Config | None = None, *, backend: Backend | None = None,
                 clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), store: Held | Tables | None = None):
        self.spark, self.model, self.config, self.backend, self.clock = spark, model, config or Config(), backend, clock
        self.store = Held(spark) if store is None else store
        self._write, self._flights, self._flight_lock = threading.RLock(), {}, threading.Lock()
        self._state = m.resident(spark.createDataFrame([], model.schema))
        held = self.store.current(self._state.schema)
        self._state = self._state if held is None else held
        self._epoch = 0 if held is None else held.agg(F.max("_epoch")).first()[0] or 0
        self._suppressed, self._reserved, self._touched = set(), set(), {}
        self.version = 0

    # reading

    def now(self) -> datetime:
        return self.clock()

    def residents(self) -> DataFrame:
        """All resident rows, expired ones too, with system columns."""
        return self._state

    def dataframe(self) -> DataFrame:
        """Live rows of the current version."""
        return self._state.where(m.live(self.now())).select(*self.model.columns())

    def scope(self, steps: Iterable[Step] = ()) -> Scope:
        """A lazy query; the version is chosen when a terminal runs."""
        return Scope(self.dataframe, self.model.keys, tuple(steps))

    def as_view(self, name: str) -> None:
        """The live rows as a temporary view for SQL."""
        self.dataframe().createOrReplaceTempView(name)

    def __len__(self) -> int:
        return self._state.count()

    def is_empty(self) -> bool:
        return self._state.isEmpty()

    def events(self) -> Subscription:
        return Subscription(self)

    def changelog(self) -> list[Row]:
        """All events so far, in order."""
        return self.store.events(0, len(self.store))

    # helpers

    def _tell(self, what: str, *args) -> None:
        if self.config.metrics is not None:
            try:
                getattr(self.config.metrics, what)(*args)
            except Exception:  # noqa: BLE001  observers cannot break the pool
                pass

    def _rows(self, rows: Iterable[dict | Row] | DataFrame) -> DataFrame:
        if isinstance(rows, DataFrame):
            return self.model.check(rows)
        names = self.model.columns()
        return self.spark.createDataFrame([tuple((r.asDict() if isinstance(r, Row) else r)[c] for c in names) for r in rows], self.model.schema)

    def _ids(self, ids: Iterable[Any] | DataFrame) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids
        return self.spark.createDataFrame([(*self._id(i), n) for n, i in enumerate(ids)], ", ".join(f"`{k}` {self.model.schema[k].dataType.simpleString()}" for k in self.model.keys) + ", _ord long")

    def _id(self, i: Any) -> tuple:
        return tuple(i) if len(self.model.keys) > 1 else (i,)

    def _key(self, row: dict | Row) -> tuple:
        return tuple(row[k] for k in self.model.keys)

    def _where(self, i: Any) -> Column:
        c = F.lit(True)
        for k, v in zip(self.model.keys, self._id(i), strict=True):
            c = c & F.col(k).eqNullSafe(F.lit(v).cast(self.model.schema[k].dataType))
        return c

    def _commit(self, merged: m.Merge) -> dict:
        """Publish a version, then its events, then the size."""
        state = self.store.save(merged.state)
        told = self.store.append(merged.events, self.model.keys)
        self._state, self.version = state, self.version + 1
        by = lambda test: sum(n for (kind, reason), n in told.items() if test(kind, reason))
        for reason in {r for _, r in told if r}:
            self._tell("eviction", reason, by(lambda k, r, reason=reason: r == reason))
        self._tell("size", state.count())
        return {"applied_items": by(lambda k, r: k != m.INVALIDATE), "tombstones_evicted": by(lambda k, r: r == m.ON_DELETE), "lru_evictions": by(lambda k, r: r == m.LRU_EVICT), "backend_reserved_skips": merged.reserved_skips}

    def _settle(self) -> DataFrame:
        """The residents with the recency of all reads since the last write."""
        if self._touched:
            kinds = ", ".join(f"`{k}` {self.model.schema[k].dataType.simpleString()}" for k in self.model.keys)
            seen = self.spark.createDataFrame([(*k, e) for k, e in self._touched.items()], f"{kinds}, _seen long")
            joined = self._state.alias("s").join(seen.alias("t"), m._on(self.model.keys, "s", "t"), "left")
            self._state = joined.select(*(f"s.{c}" for c in (*self.model.columns(), "_expires_at")), F.greatest("s._epoch", "t._seen").alias("_epoch"))
            self._touched = {}
        return self._state

    def _options(self, **more) -> dict:
        self._epoch += 1
        reserved = self._ids(self._reserved) if self._reserved else None
        return {"keys": self.model.keys, "now": self.now(), "policy": self.config.on_conflict, "ttl": self.config.default_ttl, "lru_size": self.config.lru_size, "epoch": self._epoch, "reserved": reserved, **more}

    # writing

    def insert(self, row: dict | Row, *, ttl: timedelta | None = None) -> dict:
        """Upsert one row.  With a store in mode ``error`` the store is written
        first; else the pool first and the store if it can."""
        row = row.asDict() if isinstance(row, Row) else dict(row)
        key, ttl = self._key(row), self.config.default_ttl if ttl is None else ttl
        one = self._rows([row])
        strict = self.backend is not None and self.config.failure.mode == ERROR
        with self._write:
            if key in self._reserved:
                raise Reserved(str(key))
            if self.config.on_conflict == m.REJECT and self.get(key if len(key) > 1 else key[0], touch=False) is not None:
                raise Conflict(str(key))
            if strict:
                self._reserved.add(key)
        try:
            if strict:
                try:
                    self._put(one, ttl)
                except Exception as e:
                    raise BackendFailed(str(e)) from e
            with self._write:
                self._reserved.discard(key)
                # The row itself is the newest, so the cap never evicts it.
                self._commit(m.merge(self._settle(), one, **self._options(ttl=ttl)))
        finally:
            self._reserved.discard(key)
        if self.backend is not None and not strict:
            _, error = self.config.failure.run(lambda: self._put(one, ttl), lambda e: self._tell("backend_error", e))
            if error is None:
                self._suppressed.discard(key)
        return row

    def _put(self, rows: DataFrame, ttl: timedelta | None) -> None:
        at = F.lit(m.deadline(self.now(), ttl)).cast("timestamp")
        self.backend.put(self.model, self.config.namespace, rows.withColumn("_expires_at", at), self.now())

    def insert_with_ttl(self, row: dict | Row, ttl: timedelta) -> dict:
        return self.insert(row, ttl=ttl)

    def insert_serialized(self, text: str) -> dict:
        """A row from its JSON text."""
        rows = self.spark.createDataFrame([(text,)], "t string").select(F.from_json("t", self.model.schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        try:
            row = rows.first()
        except Exception as e:
            raise SerializationFailed(str(e)) from e
        if row is None or any(row[k] is None for k in self.model.keys):
            raise SerializationFailed(text[:80])
        return self.insert(row)

    def get_many_through(self, ids: Iterable[Any] | DataFrame) -> DataFrame:
        """Live rows of the ids from this pool, and of the others from the
        store, which does not fill the pool; each id once, in no order."""
        asked = self._ids(ids).select(*self.model.keys).distinct()
        here = self.dataframe()
        hits = here.alias("s").join(asked.alias("q"), m._on(self.model.keys, "s", "q"), "left_semi")
        if self.backend is None:
            return hits
        missing = asked.alias("q").join(here.alias("s"), m._on(self.model.keys, "q", "s"), "left_anti")
        if self._suppressed:
            missing = missing.alias("q").join(self._ids(self._suppressed).alias("s"), m._on(self.model.keys, "q", "s"), "left_anti")
        found, error = self.config.failure.run(lambda: self.backend.get(self.model, self.config.namespace, missing, self.now()), lambda e: self._tell("backend_error", e))
        return hits if error is not None else hits.unionByName(found.select(*self.model.columns()))

    def insert_many(self, rows: Iterable[dict | Row] | DataFrame) -> dict:
        """Upsert rows of distinct ids at once; all or nothing under reject."""
        new = self._rows(rows)
        with self._write:
            if self.config.on_conflict == m.REJECT:
                live = self._state.where(m.live(self.now()))
                if not new.alias("i").join(live.alias("s"), m._on(self.model.keys, "i", "s"), "left_semi").isEmpty():
                    raise Conflict("a row's id is resident")
            return self._commit(m.merge(self._settle(), new, **self._options()))

    def invalidate(self, id: Any, reason: str = m.MANUAL) -> bool:
        """Remove a row; an event if it was live.  Callers cannot claim the
        reasons of the pool itself."""
        if reason not in m.PUBLIC_REASONS:
            raise ConfigError(f"reasons are {', '.join(m.PUBLIC_REASONS)}")
        found = self._invalidate(self._where(id), reason)
        if self.backend is not None:
            call = lambda: self.backend.invalidate(self.model, self.config.namespace, self._ids([id]))
            try:
                _, error = self.config.failure.run(call, lambda e: self._tell("backend_error", e))
            except Exception as e:
                raise BackendFailed(str(e)) from e
            if error is not None:
                self._suppressed.add(self._id(id))  # the store may still have it: do not read it back
            else:
                self._suppressed.discard(self._id(id))
        return found

    def _invalidate(self, which: Column, reason: str) -> bool:
        with self._write:
            gone = self._state.where(which)
            row = F.struct(*self.model.columns())
            events = gone.where(m.live(self.now())).select(F.lit(0).alias("phase"), *self.model.keys, F.lit(m.INVALIDATE).alias("kind"), F.lit(reason).alias("reason"), row.alias("old"), F.when(F.lit(False), row).alias("new"))
            before = len(self.store)
            self._commit(m.Merge(self._settle().where(~which), events))
            return len(self.store) > before

    def listen(self) -> None:
        """Apply what the store's invalidation stream has, until it ends."""
        for x in self.backend.invalidations() or ():
            which = F.lit(True) if x.id is None else self._where(x.id if len(x.id) > 1 else x.id[0])
            self._invalidate(which, m.BACKEND_INVALIDATION)

    def apply_delta(self, items, tombstones: Iterable[Any] | DataFrame = (), *, seq: Column | None = None, recovered=None) -> dict:
        """Upsert items and remove tombstones; of repeated ids the last one,
        by place in a list or by ``seq``, counts."""
        items, seq = self._sequenced(items, seq)
        dead = self._ids(tombstones)
        with self._write:
            options = self._options(seq=seq, recovered=None if recovered is None else self._ids(recovered), cursor=self.model.watermark)
            return self._commit(m.merge(self._settle(), items, tombstones=dead, **options))

    def _sequenced(self, items, seq: Column | None) -> tuple[DataFrame, Column | None]:
        if isinstance(items, DataFrame):
            return items, seq
        listed = list(items)
        last = {self._key(r): r for r in listed}
        return self._rows(last.values()), None

    def refresh(self, items, *, replace: bool = False, seq: Column | None = None) -> dict:
        """Upsert a fetched set; with ``replace`` residents that it lacks go."""
        items, seq = self._sequenced(items, seq)
        with self._write:
            return self._commit(m.merge(self._settle(), items, gone=m.MANUAL if replace else None, **self._options(seq=seq)))

    def sweep(self) -> int:
        """Remove expired rows, with an event each; their number."""
        with self._write:
            before = len(self.store)
            self._commit(m.purge_expired(self._settle(), self.now(), self.model.keys))
            return len(self.store) - before

    # fetching

    def get(self, id: Any, *, touch: bool = True) -> Row | None:
        """The live row of an id in this pool; a hit makes it the most recent."""
        row = self._state.where(self._where(id) & m.live(self.now())).select(*self.model.columns()).first()
        if touch:
            self._tell(*(("miss",) if row is None else ("hit", "l1")))
            if row is not None:
                with self._write:
                    self._epoch += 1
                    self._touched[self._id(id)] = self._epoch
        return row

    def get_through(self, id: Any) -> Row | None:
        """From this pool, else from the store, which then fills the pool."""
        row = self.get(id)
        if row is not None or self.backend is None or self._id(id) in self._suppressed:
            return row
        try:
            found, _ = self.config.failure.run(lambda: self.backend.get(self.model, self.config.namespace, self._ids([id]), self.now()).collect(), lambda e: self._tell("backend_error", e))
        except Exception as e:
            raise BackendFailed(str(e)) from e
        if not found:
            return None
        if self._key(found[0]) != self._id(id):
            raise IdentityMismatch(str(id))
        self._tell("hit", "l2")
        left = found[0]["_expires_at"]
        row = {c: found[0][c] for c in self.model.columns()}
        return self._insert_absent(row, self.config.default_ttl if left is None else left.replace(tzinfo=timezone.utc) - self.now())

    def _insert_absent(self, row: dict, ttl: timedelta | None) -> Row:
        """The live row if there is one, else ``row`` after its insertion."""
        key = self._key(row)
        id = key if len(key) > 1 else key[0]
        with self._write:
            held = self.get(id, touch=False)
            if held is not None:
                return held
            self._commit(m.merge(self._settle(), self._rows([row]), **self._options(ttl=ttl)))
        return Row(**row)

    def get_or_fetch(self, id: Any, fetcher: Callable[[Any], dict | None]) -> Row | None:
        """The live row, else what ``fetcher`` gives for the id; callers that
        ask for one id meanwhile share one fetch.  None is not kept."""
        row = self.get(id)
        if row is not None:
            return row
        key = self._id(id)
        with self._flight_lock:
            future = self._flights.get(key)
            mine = future is None
            if mine:
                future = self._flights[key] = Future()
        if not mine:
            return future.result()
        try:
            began = self.now()
            try:
                fetched = fetcher(id)
            except Exception as e:
                raise FetcherFailed(str(e)) from e
            self._tell("fetch_latency", (self.now() - began).total_seconds())
            if fetched is None:
                future.set_result(None)
            elif self._key(fetched) != key:
                raise IdentityMismatch(f"{self._key(fetched)}, not {key}")
            else:
                future.set_result(self._insert_absent(dict(fetched) if not isinstance(fetched, Row) else fetched.asDict(), self.config.default_ttl))
        except BaseException as e:
            future.set_exception(e)
        finally:
            with self._flight_lock:
                del self._flights[key]
        return future.result()

    def get_or_fetch_many(self, ids: Iterable[Any], fetcher: Callable[[list], Iterable[dict]]) -> list[Row]:
        """Rows of the ids that are live, in order and repeated as asked, then
        what ``fetcher`` gives for the others, asked for once each.  A row that
        was not asked for fails the call before anything is written."""
        asked = self._ids(list(ids))
        hits, missing = m.fetch_many_split(asked, self._state, self.model.keys, self.now())
        out = hits.orderBy("_ord").select(*self.model.columns()).collect()
        want = [tuple(r[k] for k in self.model.keys) for r in missing.orderBy("_ord").collect()]
        if not want:
            return out
        try:
            rows = list(fetcher([w if len(w) > 1 else w[0] for w in want]))
        except Exception as e:
            raise FetcherFailed(str(e)) from e
        first: dict[tuple, Any] = {}
        for r in rows:
            if self._key(r) not in set(want):
                raise IdentityMismatch(str(self._key(r)))
            first.setdefault(self._key(r), r)
        if first:
            self.insert_many(list(first.values()))
        return out + [r if isinstance(r, Row) else Row(**r) for r in first.values()]

    # snapshots

    def export_entries(self, path: str) -> None:
        snapshot.write(self._settle(), self.model, path, self.now())

    def snapshot(self, path: str, *, hints: bool = False) -> None:
        snapshot.write(self._settle(), self.model, path, self.now(), kind=snapshot.HINTS if hints else snapshot.ENTRIES)

    def restore_entries(self, path: str) -> dict:
        return self._restore(path, (snapshot.ENTRIES,))

    def restore(self, path: str) -> dict:
        """Replace all rows by a snapshot's, after every check; hints override
        the default time to live."""
        return self._restore(path, (snapshot.ENTRIES, snapshot.HINTS))

    def _restore(self, path: str, kinds: tuple[str, ...]) -> dict:
        with self._write:
            if self._reserved:
                raise Reserved("a strict write is under way")
            rows, kind = snapshot.read(self.spark, self.model, path, self.now(), lru_size=self.config.lru_size, kinds=kinds)
            counts = m.restore_counts(self._state, rows, keys=self.model.keys, now=self.now()).first().asDict()
            if kind == snapshot.HINTS:
                top = rows.agg(F.max("_epoch")).first()[0]
                self._epoch = max(self._epoch, (top or 0) + 1)
            else:
                self._epoch += 1
                at = F.lit(m.deadline(self.now(), self.config.default_ttl)).cast("timestamp")
                rows = rows.withColumns({"_expires_at": at, "_epoch": F.lit(self._epoch).cast("long")})
            merged = m.refresh_replace(self._state, rows.select(*self.model.columns()), keys=self.model.keys, now=self.now(), policy=m.UPDATE if self.config.on_conflict == m.UPDATE else m.LAST_WRITE_WINS)
            self._commit(m.Merge(rows, merged.events))
            return counts
