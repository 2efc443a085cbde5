"""More registered queries: absent values, JSON, orders, pools and their stores,
subscriptions, shots.  Importing this module adds them to the catalogue."""

from datetime import timedelta
from itertools import count

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from poolwright.errors import BackendError
from poolwright.functions.json import JsonRef, as_json, as_variant
from poolwright.functions.lower import total
from poolwright.functions.predicate import FALSE, TRUE
from poolwright.operators import merge as m
from poolwright.operators.pool import Config, Pool
from poolwright.operators.sequence import Scope
from poolwright.plans import shots
from poolwright.plans.catalogue import DOUBLE, KEY, LONG, MERGED, NOW, STRING, _delta, _items, _orders, _state, field, query, table
from poolwright.schema import Model
from poolwright.sources.backend import MemoryBackend
from poolwright.sources.versions import Tables, shared_folder
from poolwright.streaming.refresh import DeltaResult, DeltaSubscription

# --- absent values ------------------------------------------------------------------


@query("""SELECT o_orderkey, s IS NULL AS is_null, s IS NOT NULL AS is_not_null, s IS NOT NULL AS not_null_negated, true AS yes, false AS no, s IS NULL AS null_or_false, s IS NOT NULL AS present
FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)""")
def null_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = field("s", STRING, nullable=True)
    tests = {"is_null": s.is_null(), "is_not_null": s.is_not_null(), "not_null_negated": ~s.is_null(), "yes": TRUE, "no": FALSE, "null_or_false": s.is_null() | FALSE, "present": s.some().not_in([]) & TRUE}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return rows.select("o_orderkey", *(total(p).alias(k) for k, p in tests.items()))


@query("""SELECT o_orderkey, coalesce(s = 'F', false) AS eq, coalesce(s IN ('F', 'X'), false) AS in_, coalesce(s > 'F', false) AS gt, coalesce(s >= 'F', false) AS gte, coalesce(s <= 'F', false) AS lte, false AS in_none
FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)""")
def present_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = field("s", STRING, nullable=True).some()
    tests = {"eq": s.eq("F"), "in_": s.in_(["F", "X"]), "gt": s.gt("F"), "gte": s.gte("F"), "lte": s.lte("F"), "in_none": s.in_([])}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return rows.select("o_orderkey", *(total(p).alias(k) for k, p in tests.items()))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000")
def null_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return Scope(rows, ("o_orderkey",)).filter(field("s", STRING, nullable=True).is_null() & field("o_totalprice", DOUBLE).gt(1000.0) & TRUE).rows().select("o_orderkey")


# --- JSON -----------------------------------------------------------------------------

VALUES = ("null", "true", "[1]", '"s"', "3", '{"a": 1}')


@query("SELECT o_orderkey, k < 6 AND k <> 0 AS not_null, k = 0 AS null_, k = 1 AS bool_, k = 2 AS array_, k = 3 AS string_, k = 4 AS number_, k = 5 AS object_, k = 6 AS missing FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)")
def json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("o_orderkey") % 7).cast("int")
    text = F.when(at == 6, "{}").otherwise(F.concat(F.lit('{"v": '), F.get(F.array(*map(F.lit, VALUES)), at), F.lit("}")))
    rows, v = table(spark, sf_dir, "orders").select("o_orderkey", as_variant(text).alias("j")), JsonRef("j").key("v")
    tests = {"not_null": v.is_not_json_null(), "null_": v.is_json_null(), "bool_": v.is_bool(), "array_": v.is_array(), "string_": v.is_string(), "number_": v.is_number(), "object_": v.is_object(), "missing": v.missing()}
    return rows.select("o_orderkey", *(total(p).alias(k) for k, p in tests.items()))


@query("""SELECT o_orderkey, '{"k":' || o_custkey || '}' AS text, true AS last, o_custkey AS value FROM orders""")
def json_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to a document and back; of a repeated key the last value counts."""
    text = F.concat(F.lit('{"k": "first", "k" : '), F.col("o_custkey").cast("string"), F.lit(" }"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", as_variant(text).alias("j"))
    return rows.select("o_orderkey", as_json(F.col("j")).alias("text"), total(JsonRef("j").key("k").is_number()).alias("last"), F.try_variant_get("j", "$.k", "long").alias("value"))


# --- orders -----------------------------------------------------------------------------

@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS pos FROM supplier")
def seq_sort_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    def compare(a: dict, b: dict) -> int:
        return (a["s_acctbal"] < b["s_acctbal"]) - (a["s_acctbal"] > b["s_acctbal"])

    return Scope(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ("s_suppkey",)).sort(compare).numbered()


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT -1, 'new'")
def seq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    again = rows.withColumn("c_name", F.lit("again")).union(spark.createDataFrame([(-1, "new")], rows.schema))
    return Scope(rows, ("c_custkey",)).chain(again).unique().rows()


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15")
def seq_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Scope(table(spark, sf_dir, "orders"), ("o_orderkey",)).sort_by_key(-F.col("o_totalprice")).take(40).skip(5).skip(10).take(10)
    return found.rows().select("o_orderkey", "o_totalprice")


# --- pools ------------------------------------------------------------------------------

REGION = Model("region", T.StructType([T.StructField("r_regionkey", LONG), T.StructField("r_name", STRING)]), key="r_regionkey")
CUSTOMER = Model("customer", T.StructType([T.StructField("c_custkey", LONG), T.StructField("c_name", STRING), T.StructField("c_acctbal", DOUBLE)]), key="c_custkey", watermark="c_custkey")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")


def _clock():
    return NOW


@query("SELECT r_regionkey::BIGINT AS id, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS name FROM region")
def pool_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regions(spark, sf_dir)
    pool = Pool(spark, REGION, clock=_clock)
    pool.insert_many(rows.where("r_regionkey % 2 = 0"))
    found = [(r["r_regionkey"], hit["r_name"] if (hit := pool.get(r["r_regionkey"])) else None) for r in rows.collect()]
    return spark.createDataFrame(found, "id long, name string")


class _Deaf(MemoryBackend):
    """A store that cannot invalidate."""

    def invalidate(self, model, namespace, ids):
        raise BackendError("down")


@query("SELECT r_regionkey::BIGINT AS id, CASE WHEN r_regionkey <> 3 THEN r_name END AS name, r_regionkey <> 3 AS here FROM region")
def pool_get_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the store fill the pool; a row whose invalidation the store
    missed is not read back from it."""
    rows, backend = _regions(spark, sf_dir), _Deaf()
    backend.put(REGION, None, rows.withColumn("_expires_at", F.lit(None).cast("timestamp")), NOW)
    pool = Pool(spark, REGION, backend=backend, clock=_clock)
    pool.get_through(3)
    pool.invalidate(3)
    found = [(r["r_regionkey"], hit["r_name"] if (hit := pool.get_through(r["r_regionkey"])) else None) for r in rows.collect()]
    here = {r["r_regionkey"] for r in pool.dataframe().collect()}
    return spark.createDataFrame([(i, name, i in here) for i, name in found], "id long, name string, here boolean")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def pool_export_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All live entries to a snapshot and from it into another pool."""
    pools = [Pool(spark, CUSTOMER, Config(lru_size=100_000_000), clock=_clock, store=Tables(spark, shared_folder(spark, "pool"))) for _ in range(2)]
    pools[0].insert_many(_customers(spark, sf_dir).where("c_acctbal > 0"))
    pools[1].insert_many(_customers(spark, sf_dir).where("c_acctbal <= 0"))
    path = shared_folder(spark, "entries")
    pools[0].export_entries(path)
    pools[1].restore_entries(path)
    return pools[1].dataframe()


@query("SELECT c_custkey::BIGINT AS c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0")
def pool_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool kept as tables, opened again and written to."""
    root, rows = shared_folder(spark, "pool"), _customers(spark, sf_dir)
    Pool(spark, CUSTOMER, Config(lru_size=100_000_000), clock=_clock, store=Tables(spark, root)).insert_many(rows)
    pool = Pool(spark, CUSTOMER, Config(lru_size=100_000_000), clock=_clock, store=Tables(spark, root))
    pool.apply_delta(rows.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1))
    return pool.dataframe().select("c_custkey", "c_acctbal")


# --- deltas -----------------------------------------------------------------------------

@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice WHEN o_orderkey % 2 = 1 THEN o_totalprice - 5 WHEN o_orderkey % 9 = 0 THEN o_totalprice ELSE o_totalprice - 5 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def delta_recovering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that was asked for does not replace a resident of a greater cursor."""
    orders = _orders(spark, sf_dir)
    items = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") - 5)
    asked = orders.where("o_orderkey % 9 = 0").select("o_orderkey")
    return m.apply_delta(_state(orders), items, _orders(spark, sf_dir).limit(0).select("o_orderkey"), keys=KEY, now=NOW, recovered=asked, cursor="o_totalprice").state.select("o_orderkey", "o_totalprice")


LEFT = f"SELECT o_orderkey FROM ({MERGED}) ORDER BY o_orderkey % 3 = 0 DESC, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END DESC, o_orderkey LIMIT 100"


@query(f"""SELECT 0 AS phase, o_orderkey, 'invalidate' AS kind, 'on_delete' AS reason FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 = 0
UNION ALL SELECT 1, o_orderkey, 'invalidate', 'lru_evict' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM ({LEFT}))
UNION ALL SELECT 2, o_orderkey, 'insert', NULL FROM ({LEFT}) WHERE o_orderkey % 3 = 0""")
def delta_lru_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evictions of residents are told, items that never settle are not."""
    return _delta(spark, sf_dir, lru_size=100, epoch=1_000_000_000).events.select("phase", "o_orderkey", "kind", "reason")


@query("""WITH n AS (SELECT count(*) AS n, max(c_custkey)::BIGINT AS top FROM customer)
SELECT 1 AS tick, count(*) FILTER (c_custkey <= top // 2) AS resident, max(top // 2) AS watermark, count(*) FILTER (c_custkey <= top // 2) AS applied FROM customer, n
UNION ALL SELECT 2, count(*), max(top), count(*) FILTER (c_custkey >= top // 2) FROM customer, n
UNION ALL SELECT 3, count(*), max(top), count(*) FROM customer, n""")
def delta_subscription_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first tick of half the source, an update from its cursor on, a full one."""
    rows = _customers(spark, sf_dir)
    top, turn = rows.agg(F.max("c_custkey")).first()[0], count(1)

    def fetch(asked):
        seen = rows.where(F.col("c_custkey") <= top // 2) if next(turn) == 1 else rows
        return DeltaResult(m.since(seen, "c_custkey", asked.since))

    pool = Pool(spark, CUSTOMER, Config(lru_size=100_000_000), clock=_clock, store=Tables(spark, shared_folder(spark, "pool")))
    sub, out = DeltaSubscription(pool, fetch), []
    for i, tick in enumerate((sub.update, sub.update, sub.update_full)):
        told = tick()
        out.append((i + 1, len(pool), sub.watermark, told["applied_items"]))
    return spark.createDataFrame(out, "tick int, resident long, watermark long, applied long")


# --- shots --------------------------------------------------------------------------------

SHOT = """SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS id, (l_linenumber % 4)::SMALLINT AS period, (l_orderkey % 230 - 110)::INTEGER AS x, (l_partkey % 100 - 50)::INTEGER AS y, (l_discount * 4)::FLOAT AS xg, l_returnflag AS team, l_linestatus = 'F' AS goal FROM lineitem"""


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("id"), (c("l_linenumber") % 4).cast("short").alias("period"), (c("l_orderkey") % 230 - 110).cast("int").alias("x"), (c("l_partkey") % 100 - 50).cast("int").alias("y"),
        (c("l_discount") * 4).cast("float").alias("xg"), F.lit("wrist").alias("shot_type"), F.lit(False).alias("on_rebound"), c("l_returnflag").alias("team"), (c("l_linestatus") == "F").alias("goal"))


@query(f"SELECT id, x, y FROM ({SHOT}) WHERE period = 2 AND team = 'R' AND x BETWEEN -30 AND 30 AND y BETWEEN -15 AND 15 AND xg >= 0.15::FLOAT AND goal")
def shot_filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(_shots(spark, sf_dir), ("id",)).filter(shots.shot_filter(period=2, team="R", danger=True, goals=True)).rows().select("id", "x", "y")


@query("""SELECT team, round(sum(round(l * 1000)::BIGINT) / count(*) / 1000, 9) AS average FROM (SELECT l_returnflag AS team, l_discount AS l FROM lineitem) GROUP BY team UNION ALL SELECT 'none', 0.0""")
def average_xg_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = shots.team_summary(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("team"), (F.col("l_linestatus") == "F").alias("goal"), F.col("l_discount").alias("xg")))
    sums = sums.unionByName(spark.createDataFrame([("none", 0, 0, 0)], sums.schema))
    return sums.select("team", F.round(shots.average_xg(F.col("shots"), F.col("xg_milli")), 9).alias("average"))


CELL = """SELECT least(greatest(round((42 - y)::FLOAT / 84::FLOAT * 6::FLOAT)::INTEGER, 0), 6) AS r, least(greatest(round((x + 100)::FLOAT / 200::FLOAT * 10::FLOAT)::INTEGER, 0), 10) AS c, least(count(*), 65535)::INTEGER AS n
FROM (SELECT (event_id % 230 - 110)::INTEGER AS x, (user_id % 100 - 50)::INTEGER AS y FROM events) WHERE x BETWEEN -100 AND 100 AND y BETWEEN -42 AND 42 GROUP BY 1, 2"""


@query(f"SELECT max(n) AS densest, coalesce(sum(n) FILTER (r = 3 AND c = 5), 0)::BIGINT AS middle, 0::BIGINT AS outside FROM ({CELL})")
def density_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select((F.col("event_id") % 230 - 110).cast("int").alias("x"), (F.col("user_id") % 100 - 50).cast("int").alias("y"))
    grid = shots.heatmap(points, 11, 7)
    return spark.createDataFrame([(shots.max_density(grid), shots.density_at(grid, 3, 5), shots.density_at(grid, 99, 99))], "densest int, middle long, outside long")
