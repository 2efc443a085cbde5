"""Merges, pools, events, fetches, stores, snapshots."""

from datetime import timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolwright.errors import BackendFailed, ConfigError, Conflict, DuplicateId, IdentityMismatch, NetworkError, NotConfigured, SerializationFailed, TooManyEntries, WireFormatError
from poolwright.functions.predicate import Field
from poolwright.operators import merge as m
from poolwright.operators.catalog import Catalog, Trait
from poolwright.operators.pool import Config, Lagged, Metrics, Pool
from poolwright.schema import Model, unsigned
from poolwright.sources import snapshot
from poolwright.sources.backend import FailurePolicy, Invalidation, MemoryBackend, ParquetBackend, RedisBackend, keyspace
from poolwright.sources.versions import Tables

ITEM = Model("app.Item", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("group", T.StringType()), T.StructField("name", T.StringType())]))


def item(i, name="x", group="g"):
    return dict(id=i, group=group, name=name)


def make(spark, clock, **config):
    backend = config.pop("backend", None)
    return Pool(spark, ITEM, Config(**config), clock=clock, backend=backend)


def names(pool):
    return {r["id"]: r["name"] for r in pool.dataframe().collect()}


def told(events):
    return [(e["kind"], e["id"], e["reason"]) for e in events]


def test_tombstone_wins(spark, clock):
    pool = make(spark, clock)
    pool.insert(item(1, "old"))
    sub = pool.events()
    assert pool.apply_delta([item(1, "new")], [1]) == dict(applied_items=0, tombstones_evicted=1, lru_evictions=0, backend_reserved_skips=0)
    assert pool.is_empty() and told(sub.poll()) == [("invalidate", 1, "on_delete")]


def test_absence_keeps_and_last_wins(spark, clock):
    pool = make(spark, clock)
    pool.insert_many([item(1, "a"), item(2, "b")])
    assert pool.apply_delta([item(1, "first"), item(1, "new-a")])["applied_items"] == 1
    assert names(pool) == {1: "new-a", 2: "b"}
    assert pool.apply_delta([], [2, 9])["tombstones_evicted"] == 1 and names(pool) == {1: "new-a"}


def test_lru(spark, clock):
    pool = make(spark, clock, lru_size=1)
    pool.insert(item(1))
    sub = pool.events()
    assert pool.apply_delta([item(2)]) == dict(applied_items=1, tombstones_evicted=0, lru_evictions=1, backend_reserved_skips=0)
    assert told(sub.poll()) == [("invalidate", 1, "lru_evict"), ("insert", 2, None)]
    pool = make(spark, clock, lru_size=2)
    for i in (1, 2):
        pool.insert(item(i))
    pool.get(1)
    pool.insert(item(3))
    assert set(names(pool)) == {1, 3}
    # Of a batch beyond the cap the excess is neither counted nor told.
    assert pool.apply_delta([item(i) for i in (7, 8, 9)]) == dict(applied_items=2, tombstones_evicted=0, lru_evictions=2, backend_reserved_skips=0)


def test_conflicts(spark, clock):
    pool = make(spark, clock, on_conflict="reject", default_ttl=timedelta(seconds=10))
    pool.insert(item(1, "a"))
    with pytest.raises(Conflict):
        pool.insert(item(1, "b"))
    with pytest.raises(Conflict):
        pool.insert_many([item(1, "b"), item(2, "b")])
    assert names(pool) == {1: "a"}
    assert pool.apply_delta([item(1, "b"), item(2, "b")])["applied_items"] == 1 and names(pool) == {1: "a", 2: "b"}
    clock.step(10)
    pool.insert(item(1, "late"))
    assert names(pool) == {1: "late"}
    pool = make(spark, clock, on_conflict="update")
    pool.insert(item(1, "a"))
    sub = pool.events()
    pool.insert(item(1, "b"))
    e = sub.poll()[0]
    assert (e["kind"], e["old"]["name"], e["new"]["name"]) == ("update", "a", "b")


def test_ttl(spark, clock):
    pool = make(spark, clock)
    pool.insert_with_ttl(item(1), timedelta(seconds=5))
    pool.insert(item(2))
    clock.step(5)
    assert pool.get(1) is None and len(pool) == 2 and names(pool) == {2: "x"}
    assert not pool.invalidate(1) and len(pool) == 1
    pool.insert_with_ttl(item(4), timedelta.max)
    assert set(names(pool)) == {2, 4} and pool.invalidate(4)
    pool.insert_with_ttl(item(3), timedelta(seconds=1))
    clock.step(1)
    sub = pool.events()
    assert pool.sweep() == 1 and told(sub.poll()) == [("invalidate", 3, "ttl_expired")] and len(pool) == 1


def test_refresh(spark, clock):
    pool = make(spark, clock)
    pool.insert_many([item(1, "a"), item(2, "b")])
    pool.refresh([item(2, "c"), item(3, "d")])
    assert names(pool) == {1: "a", 2: "c", 3: "d"}
    sub = pool.events()
    pool.refresh([item(3, "e")], replace=True)
    assert names(pool) == {3: "e"} and told(sub.poll()) == [("invalidate", 1, "manual"), ("invalidate", 2, "manual"), ("insert", 3, None)]


def test_recovery_does_not_regress(spark, clock):
    model = Model("v", T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType())]), watermark="at")
    state = m.resident(spark.createDataFrame([(1, 10), (2, 10)], model.schema))
    items = spark.createDataFrame([(1, 5), (2, 12)], model.schema)
    asked = spark.createDataFrame([(1,), (2,)], "id long")
    out = m.apply_delta(state, items, keys=("id",), now=clock(), recovered=asked, cursor="at")
    assert {tuple(r)[:2] for r in out.state.collect()} == {(1, 10), (2, 12)}
    out = m.apply_delta(state, items, keys=("id",), now=clock(), reserved=spark.createDataFrame([(2,)], "id long"))
    assert out.stats().first()["backend_reserved_skips"] == 1 and {r["at"] for r in out.state.collect()} == {10}


def test_events_and_guards(spark, clock):
    pool = make(spark, clock, event_channel_capacity=2)
    sub = pool.events()
    for i in range(4):
        pool.insert(item(i))
    with pytest.raises(Lagged):
        sub.poll()
    assert [e["id"] for e in sub.poll()] == [2, 3] and sub.poll() == []
    with pytest.raises(ConfigError):
        pool.invalidate(1, "lru_evict")
    for bad in (dict(lru_size=0), dict(event_channel_capacity=0), dict(ttl_sweep_interval=timedelta(0)), dict(namespace=""), dict(on_conflict="maybe")):
        with pytest.raises(ConfigError):
            Config(**bad)
    with pytest.raises(ConfigError):
        FailurePolicy("retry")


def test_fetches(spark, clock):
    pool = make(spark, clock)
    calls = []

    def fetch(i):
        calls.append(i)
        return item(i, "fetched") if i < 5 else None

    assert pool.get_or_fetch(1, fetch)["name"] == "fetched" and pool.get_or_fetch(1, fetch)["name"] == "fetched" and calls == [1]
    assert pool.get_or_fetch(9, fetch) is None and not pool.scope().filter(Field("id", T.LongType(), False).eq(9)).exists()
    with pytest.raises(IdentityMismatch):
        pool.get_or_fetch(2, lambda i: item(3))
    got = pool.get_or_fetch_many([1, 4, 1, 3, 4, 8], lambda want: [item(i, "many") for i in want if i != 8] + [item(3, "again")])
    assert [(r["id"], r["name"]) for r in got] == [(1, "fetched"), (1, "fetched"), (4, "many"), (3, "many")]
    with pytest.raises(IdentityMismatch):
        pool.get_or_fetch_many([1, 6], lambda want: [item(6), item(7)])
    assert set(names(pool)) == {1, 3, 4}


class Flaky(MemoryBackend):
    def __init__(self, failures, error=NetworkError):
        super().__init__()
        self.failures, self.error, self.calls = failures, error, 0

    def _fail(self):
        self.calls += 1
        if self.failures > 0:
            self.failures -= 1
            raise self.error("down")

    def put(self, *args):
        self._fail()
        super().put(*args)

    def get(self, *args):
        self._fail()
        return super().get(*args)

    def invalidate(self, *args):
        self._fail()
        super().invalidate(*args)


def test_failure_modes(spark, clock):
    backend = Flaky(1)
    pool = make(spark, clock, backend=backend, failure=FailurePolicy("error"))
    with pytest.raises(BackendFailed):
        pool.insert(item(1))
    assert pool.is_empty()
    pool.insert(item(1))
    assert names(pool) == {1: "x"}
    waits = []
    backend = Flaky(2)
    pool = make(spark, clock, backend=backend, failure=FailurePolicy("retry", 3, waits.append))
    pool.insert(item(1))
    assert backend.calls == 3 and len(waits) == 2 and 0.025 <= waits[0] <= 0.032 and 0.05 <= waits[1] <= 0.063
    backend = Flaky(5, NotConfigured)
    pool = make(spark, clock, backend=backend)
    pool.insert(item(1))
    assert names(pool) == {1: "x"} and backend.calls == 1
    # A failed invalidation keeps the store's row from coming back.
    backend.failures = 0
    pool.insert(item(1))
    backend.failures = 1
    pool.invalidate(1)
    assert pool.get_through(1) is None
    pool.insert(item(1))
    pool.invalidate(1)
    assert pool.get_through(1) is None


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_stores(spark, clock, tmp_path, kind):
    backend = MemoryBackend() if kind == "memory" else ParquetBackend(spark, str(tmp_path))
    one, two = make(spark, clock, backend=backend, namespace="a"), make(spark, clock, backend=backend, namespace="b")
    one.insert(item(1, "kept"))
    one.insert_with_ttl(item(2, "brief"), timedelta(seconds=5))
    fresh = make(spark, clock, backend=backend, namespace="a")
    assert fresh.get_through(1)["name"] == "kept" and fresh.get_through(2)["name"] == "brief" and two.get_through(1) is None
    clock.step(5)
    assert fresh.get_through(2) is None and make(spark, clock, backend=backend, namespace="a").get_through(2) is None
    one.insert(item(1, "newer"))
    assert make(spark, clock, backend=backend, namespace="a").get_through(1)["name"] == "newer"
    one.invalidate(1)
    assert make(spark, clock, backend=backend, namespace="a").get_through(1) is None
    backend.invalidate_all(ITEM, "a")
    with pytest.raises(NotConfigured):
        RedisBackend("redis://nowhere")
    assert len({keyspace(ns, ty) for ns in (None, "a", "default") for ty in ("x", "y")}) == 6


def test_listening(spark, clock):
    class Told(MemoryBackend):
        def invalidations(self):
            return iter([Invalidation((1,)), Invalidation(None)])

    pool = make(spark, clock, backend=Told())
    pool.insert_many([item(1), item(2)])
    sub = pool.events()
    pool.listen()
    assert told(sub.poll()) == [("invalidate", 1, "backend_invalidation"), ("invalidate", 2, "backend_invalidation")]


def test_metrics_cannot_break_the_pool(spark, clock):
    seen = []

    class M(Metrics):
        def hit(self, tier):
            seen.append(tier)
            raise RuntimeError

        def miss(self):
            seen.append("miss")

        def size(self, n):
            seen.append(n)

    pool = make(spark, clock, metrics=M())
    pool.insert(item(1))
    pool.get(1)
    pool.get(2)
    assert seen == [1, "l1", "miss"]


def test_snapshots(spark, clock, tmp_path):
    pool = make(spark, clock, lru_size=3)
    for i in (3, 1, 2):
        pool.insert(item(i, f"n{i}"))
    pool.insert_with_ttl(item(2, "n2"), timedelta(seconds=60))
    pool.snapshot(f"{tmp_path}/plain")
    pool.snapshot(f"{tmp_path}/hints", hints=True)
    assert snapshot.peek_kind(spark, f"{tmp_path}/hints") == snapshot.HINTS
    other = make(spark, clock, lru_size=3)
    other.insert_many([item(1, "old"), item(9, "gone")])
    assert other.restore(f"{tmp_path}/hints") == dict(inserted=2, updated=1, removed=1)
    assert names(other) == {1: "n1", 2: "n2", 3: "n3"}
    other.insert(item(4))
    assert set(names(other)) == {1, 2, 4}  # 3 was the least recent
    clock.step(60)
    assert other.get(2) is None
    with pytest.raises(WireFormatError) as e:
        other.restore_entries(f"{tmp_path}/hints")
    assert e.value.kind == "kind_mismatch"
    with pytest.raises(TooManyEntries):
        make(spark, clock, lru_size=2).restore(f"{tmp_path}/plain")
    good = snapshot.manifest(ITEM, snapshot.ENTRIES, 1)
    import json

    for change, kind in ((dict(magic="x"), "bad_magic"), (dict(major=2), "version_mismatch"), (dict(kind="?"), "unknown_kind"), (dict(flags=1), "reserved_flags"), (dict(type_name="y"), "type_mismatch"), (dict(schema={}), "schema_mismatch")):
        with pytest.raises(WireFormatError) as e:
            snapshot.check_manifest(json.dumps({**good, **change}), ITEM)
        assert e.value.kind == kind
    for text, kind in (("{", "truncated"), ("{}", "version_mismatch")):
        with pytest.raises(WireFormatError) as e:
            snapshot.check_manifest(text, ITEM)
        assert e.value.kind == kind
    twice = spark.createDataFrame([(1, "g", "a"), (1, "g", "b")], ITEM.schema)
    snapshot.write(m.resident(twice), ITEM, f"{tmp_path}/twice", clock())
    with pytest.raises(DuplicateId):
        other.restore(f"{tmp_path}/twice")
    snapshot.write_rows(twice, ITEM, f"{tmp_path}/rows")
    assert snapshot.read_rows(spark, ITEM, f"{tmp_path}/rows").count() == 2
    with pytest.raises(WireFormatError):
        snapshot.write_rows(twice, ITEM, f"{tmp_path}/no", portable=True)


def test_serialized(spark, clock):
    pool = make(spark, clock)
    assert pool.insert_serialized('{"id": 5, "group": "g", "name": "n"}')["id"] == 5
    for bad in ("{", '{"group": "g"}'):
        with pytest.raises(SerializationFailed):
            pool.insert_serialized(bad)


def test_models():
    S, L = T.StructType, T.LongType()
    col = lambda n, t=L: T.StructField(n, t)
    for bad in (lambda: Model("", S([col("id")])), lambda: Model("m", S([])), lambda: Model("m", S([col("a")])), lambda: Model("m", S([col("id"), col("id")])), lambda: Model("m", S([col("id"), col("_x")])),
                lambda: Model("m", S([col("id")]), watermark="no"), lambda: Model("m", S([col("id"), col("s", T.StringType())]), watermark="s"), lambda: Model("m", S([col("id"), col("b", T.BooleanType())]), watermark="b"),
                lambda: Model("m", S([col("id"), col("t", S([col(str(i)) for i in range(5)]))]), watermark="t"), lambda: Model("m", S([col("id"), col("v", T.VariantType())]), wire_portable=True)):
        with pytest.raises(ConfigError):
            bad()
    m1 = Model("m", S([col("id"), col("at", S([col("a"), col("b", T.DecimalType(20, 0))]))]), watermark="at", wire_portable=True)
    assert m1.fields.id.name == "id" and m1.fields["at"].nullable and unsigned(64) == T.DecimalType(20, 0)


def test_catalog(spark, clock):
    foo, bar = (Model(n, T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])) for n in ("Foo", "Bar"))
    named = Trait("named", T.StructType([T.StructField("name", T.StringType())]))
    for model in (foo, bar):
        named.implements(model)(lambda: {"name": F.col("name")})
    catalog = Catalog(spark)
    assert catalog.all_of(named).count() == 0 and catalog.pool(foo) is None
    pools = {model.name: catalog.register(Pool(spark, model, clock=clock)) for model in (foo, bar)}
    pools["Foo"].insert(Row(id=1, name="a"))
    pools["Bar"].insert(Row(id=1, name="b"))
    assert {tuple(r) for r in catalog.all_of(named).collect()} == {("Foo", "a"), ("Bar", "b")}
    catalog.register(Pool(spark, foo, clock=clock))
    assert {tuple(r) for r in catalog.all_of(named).collect()} == {("Bar", "b")}


def test_tables(spark, clock, tmp_path):
    """Versions and log as Parquet: the same results, nothing in the driver."""
    pool = Pool(spark, ITEM, Config(lru_size=2), clock=clock, store=Tables(spark, str(tmp_path), keep=2))
    sub = pool.events()
    pool.insert_many([item(1, "a"), item(2, "b")])
    assert pool.apply_delta([item(3, "c")], [1]) == dict(applied_items=1, tombstones_evicted=1, lru_evictions=0, backend_reserved_skips=0)
    assert pool.apply_delta([item(4, "d")])["lru_evictions"] == 1
    assert told(sub.poll()) == [("insert", 1, None), ("insert", 2, None), ("invalidate", 1, "on_delete"), ("insert", 3, None), ("invalidate", 2, "lru_evict"), ("insert", 4, None)]
    assert names(pool) == {3: "c", 4: "d"} and sub.poll() == [] and len(list((tmp_path / "state").iterdir())) == 2
    assert [r["_seq"] for r in pool.store.changelog().orderBy("_seq").collect()] == list(range(6))


def test_tables_open_again(spark, clock, tmp_path):
    """At the last version whose events are there; the rest of a broken write goes."""
    one = Pool(spark, ITEM, clock=clock, store=Tables(spark, str(tmp_path), keep=2))
    one.insert_many([item(1, "a"), item(2, "b")])
    one.apply_delta([item(3, "c")], [1])
    one.store.save(one.residents().limit(0))  # a version without its events
    two = Pool(spark, ITEM, clock=clock, store=Tables(spark, str(tmp_path), keep=2))
    assert names(two) == {2: "b", 3: "c"} and len(two.store) == 4
    sub = two.events()
    two.insert(item(4, "d"))
    assert told(sub.poll()) == [("insert", 4, None)] and names(two) == {2: "b", 3: "c", 4: "d"}
    assert [r["_seq"] for r in two.store.changelog().orderBy("_seq").collect()] == list(range(5))
    assert two.residents().agg({"_epoch": "max"}).first()[0] > one.residents().agg({"_epoch": "max"}).first()[0]


def test_a_reader_keeps_its_version(spark, clock, tmp_path):
    backend = ParquetBackend(spark, str(tmp_path))
    put = lambda i: backend.put(ITEM, None, spark.createDataFrame([item(i, "x")], ITEM.schema).selectExpr("*", "cast(null as timestamp) as _expires_at"), clock())
    put(1)
    ids = spark.createDataFrame([(i,) for i in range(9)], "id long")
    held = backend.get(ITEM, None, ids, clock())
    put(2)
    assert [r["id"] for r in held.collect()] == [1]
    for i in range(3, 8):
        put(i)
    assert {r["id"] for r in backend.get(ITEM, None, ids, clock()).collect()} == set(range(1, 8))
    pointers = next(tmp_path.rglob("pointers"))
    assert len([p for p in pointers.iterdir() if p.name[0] != "."]) == ParquetBackend.KEEP


def test_bulk_reads_through(spark, clock):
    backend = MemoryBackend()
    one = make(spark, clock, backend=backend)
    for i in (1, 2, 3):
        one.insert(item(i, "stored"))
    two = make(spark, clock, backend=backend)
    two.insert_many([item(1, "own")])
    assert {(r["id"], r["name"]) for r in two.get_many_through([1, 2, 2, 9]).collect()} == {(1, "own"), (2, "stored")} and len(two) == 1


def test_composite_keys(spark, clock):
    model = Model("t", T.StructType([T.StructField("tenant", T.StringType()), T.StructField("id", T.LongType()), T.StructField("v", T.LongType())]), key=("tenant", "id"))
    pool = Pool(spark, model, clock=clock)
    pool.insert_many([dict(tenant="a", id=1, v=1), dict(tenant="b", id=1, v=2)])
    assert pool.get(("b", 1))["v"] == 2 and pool.apply_delta([], [("a", 1)])["tombstones_evicted"] == 1 and len(pool) == 1
