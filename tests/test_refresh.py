"""Delta subscriptions, periodic refresh, streaming."""

import time

import pytest
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from poolwright.errors import ConfigError, FetcherFailed
from poolwright.operators.pool import Config, Pool
from poolwright.plans import reads
from poolwright.schema import Model
from poolwright.sources.versions import Tables
from poolwright.streaming.refresh import DeltaResult, DeltaSubscription, PeriodicRefresh, stream_into
from tests.conftest import SF

MODEL = Model("Item", T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("value", T.StringType())]), watermark="at")


def row(i, at, value="v"):
    return dict(id=i, at=at, value=value)


class Source:
    def __init__(self, *results):
        self.results, self.queries = list(results), []

    def __call__(self, query):
        self.queries.append(query)
        out = self.results.pop(0)
        if isinstance(out, Exception):
            raise out
        return out


def values(pool):
    return {r["id"]: r["value"] for r in pool.dataframe().collect()}


def test_cursor(spark, clock):
    pool = Pool(spark, MODEL, clock=clock)
    source = Source(DeltaResult([row(1, 10)]), DeltaResult([row(1, 10, "again"), row(2, 13)]), DeltaResult([row(3, 5)], [2], 100), DeltaResult([row(4, 50)]), RuntimeError("down"), DeltaResult())
    sub = DeltaSubscription(pool, source)
    for _ in range(3):
        sub.update()
    assert [q.since for q in source.queries] == [None, 10, 13] and sub.watermark == 100 and values(pool) == {1: "again", 3: "v"}
    sub.update_full()
    assert source.queries[-1].since is None and sub.watermark == 100 and 4 in values(pool)
    with pytest.raises(FetcherFailed):
        sub.update()
    assert sub.watermark == 100 and source.queries[-1].since == 100
    sub.update()
    assert sub.watermark == 100


def test_subscriptions_are_independent(spark, clock):
    pool = Pool(spark, MODEL, clock=clock)
    a, b = DeltaSubscription(pool, Source(DeltaResult([row(1, 100)]))), DeltaSubscription(pool, Source(DeltaResult([row(2, 5)])))
    a.update()
    b.update()
    assert (a.watermark, b.watermark) == (100, 5) and set(values(pool)) == {1, 2}


def test_recovery(spark, clock):
    pool = Pool(spark, MODEL, Config(lru_size=1), clock=clock)
    source = Source(DeltaResult([row(1, 10)]), DeltaResult([row(2, 11)]), RuntimeError("down"), DeltaResult(), DeltaResult(), DeltaResult([row(1, 10)]))
    sub = DeltaSubscription(pool, source)
    sub.update()
    sub.update()
    assert sub.pending_recovery == 1 and sub.members == {(1,), (2,)}
    with pytest.raises(FetcherFailed):
        sub.update()
    assert source.queries[-1].recover_ids == [1] and sub.pending_recovery == 1
    # Fails once: asked again after a tick's wait.
    while source.results:
        sub.update()
    assert [q.recover_ids for q in source.queries].count([1]) == 2 and values(pool) in ({1: "v"}, {2: "v"})


@pytest.mark.parametrize("frames", [False, True])
@pytest.mark.parametrize("tables", [False, True])
def test_all_forms_of_rows_and_pools_tick_alike(spark, clock, tmp_path, tables, frames):
    """Cursor, members, queue and waits do not depend on where rows are kept
    and in what form they come; of repeated ids the last row counts."""
    ticks = [
        DeltaResult([row(1, 10), row(2, 11, "first"), row(2, 9, "last")], [7]),
        DeltaResult([row(3, 12), row(4, None)]),
        RuntimeError("down"),
        RuntimeError("down"),
        DeltaResult(high_watermark=20),
        DeltaResult([row(2, 9, "back")], [1, 4]),
        DeltaResult([row(5, 13), row(6, 14), row(8, 15)], [6]),
        DeltaResult([row(9, 1)]),
    ]
    asked = []

    def given(rows, schema):
        return spark.createDataFrame(rows, schema) if frames else rows

    def fetch(query):
        ids = query.recover_ids
        asked.append((query.since, sorted(r["id"] for r in ids.collect()) if isinstance(ids, DataFrame) else sorted(ids)))
        out = ticks.pop(0)
        if isinstance(out, Exception):
            if not frames:
                raise out
            return DeltaResult(given([row(50, 500)], MODEL.schema).withColumn("at", F.raise_error("down").cast("long")))  # fails as it is read
        return DeltaResult(given(out.items, MODEL.schema), given([(i,) for i in out.tombstones], "id long") if frames else out.tombstones, out.high_watermark)

    pool = Pool(spark, MODEL, Config(lru_size=2), clock=clock, store=Tables(spark, f"{tmp_path}/pool") if tables else None)
    sub, seen = DeltaSubscription(pool, fetch), []
    while ticks:
        clock.step(1)
        try:
            done = sub.update_full() if len(ticks) == 1 else sub.update()
        except FetcherFailed:
            done = None
        members = {tuple(r) for r in sub.members.collect()} if tables else sub.members
        seen.append((done and done["lru_evictions"], sub.watermark, sub.pending_recovery, members, values(pool)))
    assert asked == [(None, []), (11, []), (12, [1, 2]), (12, [1, 2]), (12, []), (20, [1, 2]), (20, []), (None, [])]
    assert seen == [
        (0, 11, 0, {(1,), (2,)}, {1: "v", 2: "last"}),
        (2, 12, 2, {(1,), (2,), (3,), (4,)}, {3: "v", 4: "v"}),
        (None, 12, 2, {(1,), (2,), (3,), (4,)}, {3: "v", 4: "v"}),
        (None, 12, 2, {(1,), (2,), (3,), (4,)}, {3: "v", 4: "v"}),
        (0, 20, 2, {(1,), (2,), (3,), (4,)}, {3: "v", 4: "v"}),
        (0, 20, 0, {(2,), (3,)}, {2: "back", 3: "v"}),
        (2, 20, 2, {(2,), (3,), (5,), (8,)}, {5: "v", 8: "v"}),
        (1, 20, 0, {(9,)}, {5: "v", 9: "v"}),
    ]
    if tables:  # fetched rows and what is out of date are gone
        assert len(list((tmp_path / "pool/subscriptions").glob("*/*"))) == 1


def test_a_source_of_any_size_ticks_without_rows_in_the_driver(spark, monkeypatch):
    most, plain = [0], (type(spark.range(0)).collect, spark.createDataFrame)

    def collect(self):
        out = plain[0](self)
        most.append(len(out))
        return out

    def create(data, *a, **more):
        most.append(len(data) if hasattr(data, "__len__") else 0)
        return plain[1](data, *a, **more)

    monkeypatch.setattr(type(spark.range(0)), "collect", collect)
    monkeypatch.setattr(spark, "createDataFrame", create)
    got = reads.delta_subscription_ticks(spark, SF)
    assert len(most) > 1 and max(most) <= 10
    assert got.count() == 3 and got.agg(F.max("resident")).first()[0] > 100


def test_forced_and_periodic_full(spark, clock):
    pool = Pool(spark, MODEL, clock=clock)
    source = Source(*(DeltaResult([row(1, i)]) for i in range(1, 8)))
    sub = DeltaSubscription(pool, source, full_every=3)
    for _ in range(4):
        sub.scheduled()
    assert [q.since for q in source.queries] == [None, 1, None, 3] and sub.full_progress == 1
    sub.lose_events()
    sub.update()
    assert source.queries[-1].since is None
    sub.update()
    assert source.queries[-1].since is not None


def test_manual_ticks_do_not_count_towards_a_full_one(spark, clock):
    pool = Pool(spark, MODEL, clock=clock)
    source = Source(*(DeltaResult([row(i, i)]) for i in range(8)))
    sub = DeltaSubscription(pool, source, full_every=3)
    for _ in range(4):
        sub.update()
    assert sub.full_progress == 0
    sub.scheduled()
    sub.update()
    sub.scheduled()
    assert sub.full_progress == 2 and source.queries[-1].since is not None
    sub.scheduled()
    assert sub.full_progress == 0 and source.queries[-1].since is None


def test_guards(spark, clock):
    plain = Model("P", T.StructType([T.StructField("id", T.LongType())]))
    with pytest.raises(ConfigError):
        DeltaSubscription(Pool(spark, plain, clock=clock), Source())
    with pytest.raises(ConfigError):
        DeltaSubscription(Pool(spark, MODEL, clock=clock), Source(), full_every=0)
    with pytest.raises(ConfigError):
        PeriodicRefresh(Pool(spark, MODEL, clock=clock), list, interval=0)


def test_periodic(spark, clock):
    pool = Pool(spark, MODEL, clock=clock)
    r = PeriodicRefresh(pool, lambda: [row(1, 1)], interval=60, start=False, replace=True)
    r.refresh_now()
    assert values(pool) == {1: "v"}
    r.cancel()
    assert r.refresh_now() is None
    t = PeriodicRefresh(pool, lambda: [row(2, 1)], interval=0.2, replace=True)
    for _ in range(100):
        if values(pool) == {2: "v"}:
            break
        time.sleep(0.2)
    t.cancel()
    assert values(pool) == {2: "v"}


def test_stream(spark, clock, tmp_path):
    pool = Pool(spark, MODEL, clock=clock)
    schema = "id long, at long, value string, deleted boolean, seq long"
    spark.createDataFrame([(1, 1, "a", False, 1), (1, 2, "b", False, 2), (2, 1, "c", None, 3)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    stream_into(pool, changes, seq="seq", checkpoint=f"{tmp_path}/cp").awaitTermination(120)
    assert values(pool) == {1: "b", 2: "c"}
    spark.createDataFrame([(2, 1, None, True, 4), (3, 1, "d", False, 5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream_into(pool, changes, seq="seq", checkpoint=f"{tmp_path}/cp").awaitTermination(120)
    assert values(pool) == {1: "b", 3: "d"}
