"""Refreshing pools: periodic fetches, delta subscriptions with a cursor, and
the same as Structured Streaming micro-batches.

The cursor is a place in the source, read inclusively and never moved back; it
is not an event-time watermark and nothing is dropped for being late.
"""

import logging
import threading
from collections.abc import Callable, Iterable
from concurrent.futures import Future
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from poolwright.errors import ConfigError, FetcherFailed
from poolwright.operators.merge import max_cursor
from poolwright.operators.pool import Pool
from poolwright.sources.versions import Tables
from poolwright.streaming.members import Filed, Listed

log = logging.getLogger(__name__)

DELTA, FULL = "delta", "full"


@dataclass
class DeltaQuery:
    """What a tick asks for: rows with a cursor of at least ``since`` (all, if
    None) and the rows of ``recover_ids``.  These are a list or, where there are
    some and the pool is kept as tables, a DataFrame of the key columns that can
    be read until the tick ends."""

    since: Any = None
    recover_ids: list | DataFrame = field(default_factory=list)


@dataclass
class DeltaResult:
    """Rows and removed ids, as lists or as DataFrames; of repeated ids the last
    row counts.  With DataFrames and a pool kept as tables no row passes through
    the driver."""

    items: list | DataFrame = field(default_factory=list)
    tombstones: list | DataFrame = field(default_factory=list)
    high_watermark: Any = None


class PeriodicRefresh:
    """Fetches the whole set every ``interval`` seconds, first after one
    interval; a failed fetch is logged and changes nothing."""

    def __init__(self, pool: Pool, fetch: Callable[[], Iterable[dict] | DataFrame], *, interval: float, replace: bool = False, start: bool = True):
        if interval <= 0:
            raise ConfigError("an interval is positive")
        self._pool, self._fetch, self._interval, self._replace = pool, fetch, interval, replace
        self._lock, self._cancelled, self._stop = threading.Lock(), False, threading.Event()
        if start:
            threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while not self._stop.wait(self._interval):
            try:
                self.refresh_now()
            except Exception:  # noqa: BLE001  the next tick may succeed
                log.exception("refresh failed")

    def refresh_now(self) -> dict | None:
        """One refresh, not at the same time as another; None if cancelled
        before the fetched rows were applied."""
        with self._lock:
            try:
                items = self._fetch()
            except Exception as e:
                raise FetcherFailed(str(e)) from e
            return None if self._cancelled else self._pool.refresh(items, replace=self._replace)

    def cancel(self) -> None:
        self._cancelled = True
        self._stop.set()


class DeltaSubscription:
    """Keeps a pool up to date with a source that tells changes since a cursor.

    Ids that the subscription brought in and the cap evicted are asked for
    again, after failures later each time; if they are more than the pool
    holds, a full refresh is forced.  Every ``full_every``-th scheduled tick is
    full.  A failed tick leaves cursor, members and queue as they were.
    """

    def __init__(self, pool: Pool, fetch: Callable[[DeltaQuery], DeltaResult], *, recover: bool = True, full_every: int | None = None):
        if pool.model.watermark is None:
            raise ConfigError(f"{pool.model.name} has no cursor column")
        if full_every is not None and full_every < 1:
            raise ConfigError("full_every is at least 1")
        self._pool, self._fetch, self._recover, self._every = pool, fetch, recover, full_every
        self.watermark: Any = None
        self._known = Filed(pool) if isinstance(pool.store, Tables) else Listed(pool)
        self._tick = self._progress = 0
        self._last = ""
        self._lost = self._settled = 0  # generations of lost events, and up to which a full refresh has made up
        self._seen = len(pool.store)
        self._lock, self._flight, self._cancelled = threading.Lock(), {}, False
        self._running = threading.RLock()

    @property
    def members(self) -> set[tuple] | DataFrame:
        """The ids that the subscription brought in; of a pool kept as tables a
        DataFrame, to be read before the next tick."""
        return self._known.members

    @property
    def pending_recovery(self) -> int:
        return self._known.pending

    @property
    def full_progress(self) -> int:
        return self._progress

    def lose_events(self) -> None:
        """Note that evictions may have gone unseen: a full refresh is due."""
        self._lost += 1

    def update(self) -> dict:
        """One tick, or the one under way; full if a full one is due."""
        return self._shared(DELTA, lambda: self._run(FULL if self._due() else DELTA))

    def update_full(self) -> dict:
        """A full tick; one waits for a delta tick under way, more share it."""
        return self._shared(FULL, lambda: self._run(FULL))

    def scheduled(self) -> dict:
        """The tick that a timer runs."""
        if self._every is not None and self._progress + 1 >= self._every:
            return self.update_full()
        out = self.update()
        if self._last == DELTA:
            self._progress += 1  # only the timer's ticks count towards a full one
        return out

    def cancel(self) -> None:
        self._cancelled = True

    def start(self, interval: float) -> "DeltaSubscription":
        if interval <= 0:
            raise ConfigError("an interval is positive")

        def run() -> None:
            wait = threading.Event()
            while not wait.wait(interval) and not self._cancelled:
                try:
                    self.scheduled()
                except Exception:  # noqa: BLE001
                    log.exception("delta refresh failed")

        threading.Thread(target=run, daemon=True).start()
        return self

    def _shared(self, kind: str, run: Callable[[], dict]) -> dict:
        with self._lock:
            future = self._flight.get(kind)
            mine = future is None
            if mine:
                future = self._flight[kind] = Future()
        if mine:
            try:
                with self._running:
                    future.set_result(run())
            except BaseException as e:
                future.set_exception(e)
            finally:
                with self._lock:
                    del self._flight[kind]
        return future.result()

    def _due(self) -> bool:
        return self._recover and (self._lost > self._settled or self._known.pending > self._pool.config.lru_size)

    def _observe(self) -> None:
        """Queue members that were evicted since the last look."""
        end = len(self._pool.store)
        if self._recover:
            self._known.observe(self._seen, end)
        self._seen = end

    def _run(self, kind: str) -> dict:
        pool, known, full = self._pool, self._known, kind == FULL
        self._tick += 1
        self._observe()
        generation = self._lost
        asked = known.take(None if full else self._tick)
        before = known.mark()
        query = DeltaQuery(None if full else self.watermark, [] if full else known.ids(asked))
        try:
            batch = known.stage(self._fetch(query), self.watermark)
            # Members before the write, so that its evictions are recognised.
            known.adopt(batch, asked, full=full)
            stats = pool.apply_delta(batch.items, batch.dead, seq=batch.seq, recovered=query.recover_ids if asked and not full else None)
        except BaseException as e:
            known.undo(before, asked, self._tick)
            raise FetcherFailed(str(e)) from e if isinstance(e, Exception) else e
        finally:
            known.clear()
        self._observe()
        known.keep(before, asked)
        self.watermark = batch.cursor
        self._last = kind
        if full:
            self._settled, self._progress = max(self._settled, generation), 0
        return stats


def stream_into(pool: Pool, changes: DataFrame, *, seq: str, deleted: str = "deleted", checkpoint: str, trigger: dict | None = None):
    """Run a stream of changes (the model's columns, a boolean ``deleted`` and
    ``seq``) into a pool: each micro-batch is one delta, of repeated ids the
    last by ``seq`` counts.  Start it again from its checkpoint to go on."""

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            gone = F.coalesce(F.col(deleted), F.lit(False))
            pool.apply_delta(batch.where(~gone).select(*pool.model.columns(), seq), batch.where(gone).select(*pool.model.keys), seq=F.col(seq))
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def cursor_ticks(source: DataFrame, cursor: str, ends: list) -> list[tuple[DataFrame, Any]]:
    """The rows that each of several ticks reads, and the cursor after it; the
    source is seen up to each of ``ends`` in turn."""
    out, at = [], None
    for end in ends:
        seen = source.where(F.col(cursor) <= F.lit(end))
        rows = seen if at is None else seen.where(F.col(cursor) >= F.lit(at))
        at = max_cursor(rows, cursor, since=at)
        out.append((rows, at))
    return out
