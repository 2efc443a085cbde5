"""Change application as pure functions of DataFrames.

A resident row has the model's columns and ``_expires_at`` (null: never) and
``_epoch`` (recency).  A merge takes the residents and a batch of changes and
gives the new residents, the events in their order and the counts.
"""

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.errors import ConfigError

LAST_WRITE_WINS, REJECT, UPDATE = "last_write_wins", "reject", "update"
POLICIES = (LAST_WRITE_WINS, REJECT, UPDATE)

# Event kinds and reasons; callers may give the first three reasons only.
INSERT, UPDATED, INVALIDATE = "insert", "update", "invalidate"
MANUAL, ON_SAVE, ON_DELETE = "manual", "on_save", "on_delete"
LRU_EVICT, TTL_EXPIRED, BACKEND_INVALIDATION = "lru_evict", "ttl_expired", "backend_invalidation"
PUBLIC_REASONS = (MANUAL, ON_SAVE, ON_DELETE)


@dataclass
class Merge:
    """``state`` and ``events`` (phase, key columns, kind, reason, old, new)
    are DataFrames; ``stats()`` counts the events of the batch."""

    state: DataFrame
    events: DataFrame
    reserved_skips: int = 0

    def stats(self) -> DataFrame:
        count = lambda c, name: F.count_if(c).alias(name)
        return self.events.agg(
            count(F.col("kind").isin(INSERT, UPDATED), "applied_items"),
            count(F.col("reason") == ON_DELETE, "tombstones_evicted"),
            count(F.col("reason") == LRU_EVICT, "lru_evictions"),
            F.lit(self.reserved_skips).cast("long").alias("backend_reserved_skips"))


def resident(rows: DataFrame, *, expires_at: Column | None = None, epoch: Column | None = None) -> DataFrame:
    """``rows`` as residents."""
    return rows.withColumns({
        "_expires_at": (F.lit(None) if expires_at is None else expires_at).cast("timestamp"),
        "_epoch": (F.lit(0) if epoch is None else epoch).cast("long")})


def deadline(now: datetime, ttl: timedelta | None) -> datetime | None:
    """When a row written now expires; never, if the time is beyond all dates."""
    try:
        return None if ttl is None else now + ttl
    except OverflowError:
        return None


def live(now: datetime, prefix: str = "") -> Column:
    """Resident and not expired: the deadline itself is past."""
    at = F.col(f"{prefix}_expires_at")
    return at.isNull() | (at > F.lit(now))


def _on(keys: tuple[str, ...], left: str, right: str) -> Column:
    return reduce(and_, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def capped(state: DataFrame, lru_size: int, now: datetime, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """At most ``lru_size`` rows, and those evicted (None: none were).  Over
    the cap expired rows go first, then the least recent; equal ones by key."""
    if state.limit(lru_size + 1).count() <= lru_size:
        return state, None
    fresh = state.where(live(now))
    if fresh.limit(lru_size + 1).count() <= lru_size:
        return fresh, fresh.limit(0)
    kept = fresh.orderBy(F.col("_epoch").desc(), *keys).limit(lru_size)
    victims = fresh.alias("a").join(kept.select(*keys).alias("b"), _on(keys, "a", "b"), "left_anti")
    return kept, victims


def merge(state: DataFrame, items: DataFrame, *, keys: tuple[str, ...], now: datetime, tombstones: DataFrame | None = None, gone: str | None = None,
          policy: str = LAST_WRITE_WINS, ttl: timedelta | None = None, lru_size: int | None = None, seq: Column | None = None, epoch: int = 1,
          reserved: DataFrame | None = None, recovered: DataFrame | None = None, cursor: str | None = None) -> Merge:
    """Residents after a batch of items and removals.

    An item whose key has a tombstone is dropped; of repeated keys the last
    counts; an expired resident counts as absent; under ``reject`` live
    residents stay.  ``gone`` names the reason with which live residents that
    the items lack are removed (a replacement).  If a key is ``reserved``
    nothing changes.  A row that was asked for to recover an evicted one
    (``recovered``) does not replace a resident of a greater ``cursor``.
    Events: removals, evictions, writes, each by key.
    """
    if policy not in POLICIES:
        raise ConfigError(f"no policy {policy!r}")
    columns = [c for c in state.columns if c not in ("_expires_at", "_epoch")]
    if reserved is not None:
        skips = _touching(items, tombstones, reserved, keys)
        if skips:
            return Merge(state, _no_events(state, keys, columns), skips)
    both = _aligned(state, items, tombstones, recovered, keys, columns, seq)
    was_live = F.col("_had") & live(now)
    take = F.col("_item")
    if policy == REJECT:
        take = take & ~was_live
    if recovered is not None and cursor is not None:
        stale = F.col("_asked") & was_live & (F.col(f"old.{cursor}") > F.col(f"new.{cursor}"))
        take = take & ~F.coalesce(stale, F.lit(False))
    both = both.withColumns({"_live": was_live, "_take": take})
    absent = ~F.col("_item") if gone else F.lit(False)
    removed = F.col("_had") & ~F.col("_take") & (F.col("_dead") | absent)
    until = F.lit(deadline(now, ttl)).cast("timestamp")
    chosen = F.when(F.col("_take"), F.col("new")).otherwise(F.col("old"))
    after = both.where(~removed & (F.col("_take") | F.col("_had"))).select(
        *(chosen[c].alias(c) for c in columns),
        F.when(F.col("_take"), until).otherwise(F.col("_expires_at")).alias("_expires_at"),
        F.when(F.col("_take"), F.lit(epoch).cast("long")).otherwise(F.col("_epoch")).alias("_epoch"))
    victims = None
    if lru_size is not None:
        after, victims = capped(after, lru_size, now, keys)
    none = F.lit(None).cast(both.schema["old"].dataType)
    why = F.when(F.col("_dead"), ON_DELETE).otherwise(F.lit(gone or ON_DELETE))
    event = lambda phase, kind, reason, old, new: [F.lit(phase).alias("phase"), *keys, kind.alias("kind"), reason.cast("string").alias("reason"), old.alias("old"), new.alias("new")]
    events = both.where(removed & F.col("_live")).select(*event(0, F.lit(INVALIDATE), why, F.col("old"), none))
    writes = both.where("_take")
    if victims is not None:
        mine = both.where(F.col("_live") & ~removed).alias("b").join(victims.select(*keys).alias("v"), _on(keys, "b", "v"), "left_semi")
        events = events.unionByName(mine.select(*event(1, F.lit(INVALIDATE), F.lit(LRU_EVICT), F.col("old"), none)))
        writes = writes.alias("b").join(after.select(*keys).alias("v"), _on(keys, "b", "v"), "left_semi")
    updated = F.lit(policy == UPDATE) & F.col("_live")
    events = events.unionByName(writes.select(*event(2, F.when(updated, UPDATED).otherwise(INSERT), F.lit(None), F.when(updated, F.col("old")), F.col("new"))))
    return Merge(after, events)


def _aligned(state: DataFrame, items: DataFrame, tombstones: DataFrame | None, recovered: DataFrame | None, keys: tuple[str, ...], columns: list[str], seq: Column | None) -> DataFrame:
    """A row for each key: the resident (old), the last item that no tombstone
    overrides (new), and what is said of the key.  All sides are united and
    aggregated by key, so the merge takes one shuffle, and repeated items
    collapse before it."""
    schema = state.select(*columns)
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    none = lambda kind: F.lit(None).cast(kind)
    turn = items.select((F.lit(0) if seq is None else seq).alias("s")).schema["s"].dataType
    whole = schema.select(row.alias("r")).schema["r"].dataType

    def side(df: DataFrame, kind: str, old=None, new=None, at=None, epoch=None, order=None) -> DataFrame:
        return df.select(*(F.col(f"`{k}`") for k in keys), F.lit(kind).alias("_kind"), (none(whole) if old is None else old).alias("old"), (none(whole) if new is None else new).alias("new"),
                         (none("timestamp") if at is None else at).alias("_expires_at"), (none("long") if epoch is None else epoch).alias("_epoch"), (none(turn) if order is None else order).alias("_order"))

    all_ = side(state, "resident", old=row, at=F.col("_expires_at"), epoch=F.col("_epoch")).union(side(items, "item", new=row, order=F.lit(0) if seq is None else seq))
    if tombstones is not None:
        all_ = all_.union(side(tombstones, "dead"))
    if recovered is not None:
        all_ = all_.union(side(recovered, "asked"))
    has = lambda kind: F.bool_or(F.col("_kind") == kind)
    last = F.first("new", ignorenulls=True) if seq is None else F.max_by("new", "_order")
    out = all_.groupBy(*keys).agg(
        F.first("old", ignorenulls=True).alias("old"), last.alias("new"), F.max("_expires_at").alias("_expires_at"), F.max("_epoch").alias("_epoch"),
        has("resident").alias("_had"), has("item").alias("_item"), has("dead").alias("_dead"), has("asked").alias("_asked"))
    out = out.withColumn("_item", F.col("_item") & ~F.col("_dead"))
    return out.withColumn("new", F.when(F.col("_item"), F.col("new"))).where("_had or _item")


def _touching(items: DataFrame, tombstones: DataFrame | None, reserved: DataFrame, keys: tuple[str, ...]) -> int:
    """Keys of the batch that are reserved."""
    touched = items.select(*keys) if tombstones is None else items.select(*keys).union(tombstones.select(*keys))
    return touched.distinct().alias("i").join(reserved.select(*keys).alias("r"), _on(keys, "i", "r"), "left_semi").count()


def _no_events(state: DataFrame, keys: tuple[str, ...], columns: list[str]) -> DataFrame:
    row = F.struct(*columns)
    return state.limit(0).select(F.lit(0).alias("phase"), *keys, F.lit("").alias("kind"), F.lit("").alias("reason"), row.alias("old"), row.alias("new"))


def apply_delta(state: DataFrame, items: DataFrame, tombstones: DataFrame | None = None, **options) -> Merge:
    """Upsert ``items`` and remove ``tombstones``, which win; what the delta
    does not name stays."""
    return merge(state, items, tombstones=tombstones, **options)


def refresh_upsert(state: DataFrame, items: DataFrame, **options) -> Merge:
    """Upsert all items; residents that were not fetched stay."""
    return merge(state, items, **options)


def refresh_replace(state: DataFrame, items: DataFrame, **options) -> Merge:
    """Upsert all items; residents that were not fetched are removed."""
    return merge(state, items, gone=MANUAL, **options)


def restore_counts(state: DataFrame, snapshot: DataFrame, *, keys: tuple[str, ...], now: datetime) -> DataFrame:
    """inserted, updated and removed of replacing ``state`` by ``snapshot``."""
    old = state.where(live(now)).select(*keys).withColumn("_o", F.lit(1)).alias("o")
    new = snapshot.select(*keys).withColumn("_n", F.lit(1)).alias("n")
    both = old.join(new, _on(keys, "o", "n"), "full_outer")
    o, n = F.col("_o").isNotNull(), F.col("_n").isNotNull()
    return both.agg(F.count_if(n & ~o).alias("inserted"), F.count_if(n & o).alias("updated"), F.count_if(o & ~n).alias("removed"))


def purge_expired(state: DataFrame, now: datetime, keys: tuple[str, ...]) -> Merge:
    """A sweep: expired residents go, each with an event."""
    columns = [c for c in state.columns if c not in ("_expires_at", "_epoch")]
    row = F.struct(*columns)
    events = state.where(~live(now)).select(F.lit(0).alias("phase"), *keys, F.lit(INVALIDATE).alias("kind"), F.lit(TTL_EXPIRED).alias("reason"), row.alias("old"), F.when(F.lit(False), row).alias("new"))
    return Merge(state.where(live(now)), events)


def max_cursor(items: DataFrame, cursor: str, explicit=None, since=None):
    """The new cursor: the greatest of the old one, the explicit one and those
    of the items; never less than before."""
    found = items.agg(F.max(cursor)).first()[0]
    seen = [x for x in (since, explicit, found) if x is not None]
    return max(seen) if seen else None


def since(rows: DataFrame, cursor: str, at) -> DataFrame:
    """The inclusive part of a source from a cursor on; all without one."""
    return rows if at is None else rows.where(F.col(cursor) >= F.lit(at))


# --- many-id fetch ------------------------------------------------------------

def fetch_many_split(ids: DataFrame, state: DataFrame, keys: tuple[str, ...], now: datetime) -> tuple[DataFrame, DataFrame]:
    """(hits, missing) of ``ids`` (keys, ``_ord``): rows of live residents in
    the order of the ids, repeats repeated; missing ids once, first seen first."""
    rows = state.where(live(now)).drop("_expires_at", "_epoch")
    hits = ids.alias("q").join(rows.alias("s"), _on(keys, "q", "s")).select("s.*", "q._ord")
    missing = ids.alias("q").join(rows.alias("s"), _on(keys, "q", "s"), "left_anti").groupBy(*keys).agg(F.min("_ord").alias("_ord"))
    return hits, missing


def fetch_many(ids: DataFrame, state: DataFrame, source: DataFrame, keys: tuple[str, ...], now: datetime) -> DataFrame:
    """Hits in order, then the missing ids that ``source`` has, in its order by
    key; ``_from`` tells which."""
    hits, missing = fetch_many_split(ids, state, keys, now)
    fetched = source.alias("s").join(missing.alias("m"), _on(keys, "s", "m")).select("s.*", "m._ord")
    return hits.withColumn("_from", F.lit("pool")).unionByName(fetched.withColumn("_from", F.lit("source")))
