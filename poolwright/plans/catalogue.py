"""Registered queries over the driver's tables, and their SQL.

Each query runs over whole tables.  ``ORACLE_SQL`` has the same result in
DuckDB's SQL; timestamps are compared as they are, in UTC.
"""

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from poolwright.functions.json import JsonRef, as_variant, compare_exactly
from poolwright.functions.lower import ascii_folded, total
from poolwright.functions.predicate import Field
from poolwright.operators import merge as m
from poolwright.operators.catalog import Trait
from poolwright.operators.sequence import Scope
from poolwright.plans import shots
from poolwright.schema import Model
from poolwright.sources import snapshot
from poolwright.sources.backend import hex_key, keyspace
from poolwright.streaming.refresh import cursor_ticks

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    """Register a query under its function's name with its SQL."""

    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str, kind: T.DataType, nullable: bool = False) -> Field:
    return Field(name, kind, nullable)


STRING, LONG, DOUBLE, INT = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
STATUS, PRICE, ORDER = field("o_orderstatus", STRING), field("o_totalprice", DOUBLE), field("o_orderkey", LONG)
NAME, SIZE = field("p_name", STRING), field("p_size", INT)


# --- scopes and predicates ------------------------------------------------------

@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000 ORDER BY o_totalprice, o_orderkey LIMIT 10")
def scope_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Scope(table(spark, sf_dir, "orders"), ("o_orderkey",)).filter(STATUS.eq("O") & PRICE.gte(200000.0)).sort_by_key("o_totalprice", "o_orderkey").take(10)
    return found.dataframe().select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem
WHERE ((l_quantity >= 10 AND l_quantity < 30) OR NOT (l_returnflag IN ('A', 'N'))) AND ((l_discount > 0.05) <> (l_linestatus = 'F')) AND NOT (l_tax > 0.07 OR l_linenumber = 7)
GROUP BY l_returnflag""")
def pred_and_or_not_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, flag, disc, status, tax, line = field("l_quantity", DOUBLE), field("l_returnflag", STRING), field("l_discount", DOUBLE), field("l_linestatus", STRING), field("l_tax", DOUBLE), field("l_linenumber", INT)
    p = ((q.gte(10.0) & q.lt(30.0)) | ~flag.in_(["A", "N"])) & (disc.gt(0.05) ^ status.eq("F")) & ~(tax.gt(0.07) | line.eq(7))
    rows = Scope(table(spark, sf_dir, "lineitem"), ("l_orderkey",)).filter(p).rows()
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("""SELECT o_orderkey, o_totalprice < 50000 AS lt, o_totalprice <= 50000 AS lte, o_totalprice > 50000 AS gt, o_totalprice >= 50000 AS gte, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS neq FROM orders""")
def lookup_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"lt": PRICE.lt(50000.0), "lte": PRICE.lte(50000.0), "gt": PRICE.gt(50000.0), "gte": PRICE.gte(50000.0), "eq": STATUS.eq("F"), "neq": STATUS.neq("F")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(total(p).alias(k) for k, p in tests.items()))


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT (p_size BETWEEN 20 AND 10)")
def lookup_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(table(spark, sf_dir, "part"), ("p_partkey",)).filter(SIZE.between(10, 20) & ~SIZE.between(20, 10)).rows().select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 13) OR p_size NOT IN (SELECT unnest(range(0, 45)))")
def lookup_in_notin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SIZE.in_([1, 5, 9, 13]) | (SIZE.not_in(range(45)) & SIZE.not_in([]) & ~SIZE.in_([]))
    return Scope(table(spark, sf_dir, "part"), ("p_partkey",)).filter(p).rows().select("p_partkey", "p_size")


@query("""SELECT o_orderkey, s IS NOT DISTINCT FROM 'F' AS eq, s IS DISTINCT FROM 'F' AS neq, s IS NULL AS eq_null, coalesce(s > 'F', false) AS gt, s IS NULL OR s < 'O' AS lt, s IS NULL OR s <= 'F' AS lte,
  coalesce(s = 'F', false) OR s IS NULL AS in_null, NOT coalesce(s = 'F', false) AS not_in, coalesce(s <> 'F', false) AS some_neq, coalesce(s < 'O', false) AS some_lt, s IS NOT NULL AND s <> 'F' AS some_not_in, s IS NOT NULL AS some_not_in_empty,
  coalesce(s BETWEEN 'A' AND 'G', false) AS some_between, (s IS NULL OR s <= 'G') AND coalesce(s >= 'A', false) AS between_
FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)""")
def option_raw_vs_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = field("s", STRING, nullable=True)
    tests = {"eq": s.eq("F"), "neq": s.neq("F"), "eq_null": s.eq(None), "gt": s.gt("F"), "lt": s.lt("O"), "lte": s.lte("F"), "in_null": s.in_([None, "F"]), "not_in": s.not_in(["F"]),
             "some_neq": s.some().neq("F"), "some_lt": s.some().lt("O"), "some_not_in": s.some().not_in(["F"]), "some_not_in_empty": s.some().not_in([]), "some_between": s.some().between("A", "G"), "between_": s.between("A", "G")}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return rows.select("o_orderkey", *(total(p).alias(k) for k, p in tests.items()))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '1-URGENT') AS p FROM orders)
WHERE NOT (coalesce(s = 'F', false) AND (p IS NULL OR p < '4')) AND (coalesce(s = 'O', false) <> coalesce(p > '2', false))""")
def option_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = field("s", STRING, nullable=True), field("p", STRING, nullable=True)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return Scope(rows, ("o_orderkey",)).filter(~(s.eq("F") & p.lt("4")) & (s.eq("O") ^ p.gt("2"))).rows().select("o_orderkey")


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(f"""SELECT p_partkey, contains(p_name, 'a') AS contains, contains(translate(p_name, {AZ}), 're') AS icontains, starts_with(p_name, 's') AS starts_with, starts_with(translate(p_name, {AZ}), 'p') AS istarts_with,
  ends_with(p_name, 'e') AS ends_with, ends_with(translate(p_name, {AZ}), '1') AS iends_with, translate(p_name, {AZ}) = 'part 7' AS iexact, contains(p_name, '') AS empty, contains(p_name, '%') AS percent FROM part""")
def string_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"contains": NAME.contains("a"), "icontains": NAME.icontains("RE"), "starts_with": NAME.starts_with("s"), "istarts_with": NAME.istarts_with("P"), "ends_with": NAME.ends_with("e"),
             "iends_with": NAME.iends_with("1"), "iexact": NAME.iexact("PART 7"), "empty": NAME.contains(""), "percent": NAME.contains("%")}
    return table(spark, sf_dir, "part").select("p_partkey", *(total(p).alias(k) for k, p in tests.items()))


@query(f"SELECT doc_id, contains(translate(text, {AZ}), translate('Été', {AZ})) AS accent, md5(translate(text, {AZ})) AS folded FROM documents")
def string_ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = field("text", STRING)
    return table(spark, sf_dir, "documents").select("doc_id", total(text.icontains("Été")).alias("accent"), F.md5(ascii_folded(F.col("text"))).alias("folded"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND starts_with(o_orderpriority, '1') AND o_orderkey % 3 = 0")
def closure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def third(row: dict) -> bool:
        return 1 // (row["o_orderkey"] % 3 == 0) == 1  # raises for the others, which then do not match

    return Scope(table(spark, sf_dir, "orders"), ("o_orderkey",)).filter(PRICE.gt(100000.0) & field("o_orderpriority", STRING).starts_with("1")).filter(third).rows().select("o_orderkey")


# --- JSON -----------------------------------------------------------------------

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _props(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, JsonRef]:
    return table(spark, sf_dir, "events").select("event_id", as_variant(F.col("props")).alias("props")), JsonRef("props")


@query("SELECT event_id, true AS exists_k, true AS missing_z, false AS null_k, true AS num_k, false AS str_k, true AS root_object, true AS has_k, false AS has_any_none, true AS has_all_none, true AS any_kz, false AS all_kz FROM events")
def json_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, j = _props(spark, sf_dir)
    k = j.key("k")
    tests = {"exists_k": k.exists(), "missing_z": j.key("z").missing(), "null_k": k.is_json_null(), "num_k": k.is_number(), "str_k": k.is_string(), "root_object": j.is_object(), "has_k": j.has_key("k"),
             "has_any_none": j.has_any_key([]), "has_all_none": j.has_all_keys([]), "any_kz": j.has_any_key(["k", "z"]), "all_kz": j.has_all_keys(["k", "z"])}
    return rows.select("event_id", *(total(p).alias(c) for c, p in tests.items()))


@query(f"""SELECT event_id, {K} = 5 AS eq, {K} <> 5 AS neq, {K} > 49.5 AS gt, {K} >= 50 AS gte, {K} < 50 AS lt, {K} <= 49.5 AS lte, {K} IN (1, 2, 3) AS in_, {K} NOT IN (1, 2, 3) AS not_in, {K} BETWEEN 10 AND 20 AS between_,
  false AS as_text, false AS missing_neq, {K} = 7 AS doc, {K} <> 7 AS not_doc FROM events""")
def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, j = _props(spark, sf_dir)
    k = j.at("k").value("number")
    tests = {"eq": k.eq(5.0), "neq": k.neq(5), "gt": k.gt(49.5), "gte": k.gte(50), "lt": k.lt(50), "lte": k.lte(49.5), "in_": k.in_([1, 2.0, 3]), "not_in": k.not_in([1, 2, 3]), "between_": k.between(10, 20),
             "as_text": j.key("k").value("string").eq("5"), "missing_neq": j.key("z").value("number").neq(1), "doc": j.eq_json({"k": 7.0}), "not_doc": j.neq_json({"k": 7})}
    return rows.select("event_id", *(total(p).alias(c) for c, p in tests.items()))


@query("""SELECT o_orderkey, n = 2 AS len_two, n > 1 AS len_gt, o_custkey % 3 = 1 AS has_one, n = 2 AND o_custkey % 3 = 2 AS whole, n <> 2 OR o_custkey % 3 <> 2 AS not_whole FROM (SELECT o_orderkey, o_custkey, 1 + o_orderkey % 2 AS n FROM orders)""")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("o_orderkey") % 2 == 1, F.lit(', {"x": [1.0]}')).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", as_variant(F.concat(F.lit('{"a": ['), (F.col("o_custkey") % 3).cast("string"), last, F.lit("]}"))).alias("j"))
    a = JsonRef("j").key("a")
    tests = {"len_two": a.array_len_eq(2), "len_gt": a.array_len_gt(1), "has_one": a.array_contains(1.0), "whole": a.eq_json([2, {"x": [1]}]), "not_whole": a.neq_json([2, {"x": [1]}])}
    return rows.select("o_orderkey", *(total(p).alias(c) for c, p in tests.items()))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < d THEN -1 WHEN o_orderkey > d THEN 1 ELSE 0 END AS cmp FROM (SELECT o_orderkey, o_custkey + (o_orderkey % 4) / 4.0::DOUBLE AS d FROM orders)")
def json_exact_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_custkey").cast("double") + (F.col("o_orderkey") % 4) / F.lit(4.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", compare_exactly(F.col("o_orderkey").cast("decimal(20,0)"), d).alias("cmp"))


# --- sequences ------------------------------------------------------------------

@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 25")
def seq_sort_take_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(table(spark, sf_dir, "orders"), ("o_orderkey",)).sort_by_key("o_totalprice").skip(25).take(50).dataframe().select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def seq_unique_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(table(spark, sf_dir, "orders"), ("o_orderkey",)).unique_by("o_custkey").rows().select("o_orderkey", "o_custkey")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY f, event_id) - 1 AS pos FROM (SELECT event_id, event_type, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)")
def seq_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(table(spark, sf_dir, "events").select("event_id", "event_type"), ("event_id",)).group_by("event_type").numbered()


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_type <> 'click', event_id) - 1 AS pos FROM events")
def seq_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(table(spark, sf_dir, "events").select("event_id", "event_type"), ("event_id",)).partition(field("event_type", STRING).eq("click")).numbered()


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY s, o) - 1 AS pos FROM (SELECT n_nationkey, n_name, 0 AS s, n_nationkey AS o FROM nation UNION ALL SELECT 3, 'again', 1, 0 UNION ALL SELECT 3, 'again', 1, 1 UNION ALL SELECT 99, 'new', 1, 2)")
def seq_chain_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = [{"n_nationkey": 3, "n_name": "again"}, {"n_nationkey": 3, "n_name": "again"}, {"n_nationkey": 99, "n_name": "new"}]
    return Scope(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ("n_nationkey",)).chain(more).numbered()


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem UNION ALL SELECT l_orderkey, -l_linenumber, l_quantity * 2 FROM lineitem WHERE l_returnflag = 'R'""")
def seq_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = {"l_linenumber": -F.col("l_linenumber"), "l_quantity": F.col("l_quantity") * 2, "_when": F.col("l_returnflag") == "R"}
    return Scope(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber")).flat_map({}, again).rows().select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size + 100 AS p_size, p_name FROM part")
def seq_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(table(spark, sf_dir, "part"), ("p_partkey",)).map(p_size=F.col("p_size") + 100).rows().select("p_partkey", "p_size", "p_name")


@query("SELECT p_partkey, p_size * 2 AS p_size FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_size % 2 = 0")
def seq_map_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    def twice(row: dict) -> list[dict]:
        return [{**row, "p_size": row["p_size"] * 2}, {**row, "p_size": 0}] if row["p_size"] % 2 == 0 else []

    return Scope(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ("p_partkey",)).flat_map(twice).rows()


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1")
def seq_fold_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(table(spark, sf_dir, "customer"), ("c_custkey",)).fold_max("c_acctbal").rows().select("c_custkey", "c_acctbal")


@query("SELECT min(n_nationkey)::INTEGER AS n_nationkey, 'ALL' AS n_name, sum(n_regionkey)::INTEGER AS n_regionkey FROM nation")
def seq_fold_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(rows: list[dict]) -> dict:
        return {"n_nationkey": rows[0]["n_nationkey"], "n_name": "ALL", "n_regionkey": sum(r["n_regionkey"] for r in rows)}

    return Scope(table(spark, sf_dir, "nation"), ("n_nationkey",)).fold(fold).rows()


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1 ORDER BY o_totalprice, o_orderkey LIMIT 128""")
def seq_mixed_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scope(table(spark, sf_dir, "orders"), ("o_orderkey",)).filter(STATUS.eq("F")).unique_by("o_custkey").sort_by_key("o_totalprice").take(128).dataframe().select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, count(*) > 0 AS some, min(s_suppkey) AS first FROM supplier WHERE s_acctbal > 0")
def terminal_count_exists_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = Scope(table(spark, sf_dir, "supplier"), ("s_suppkey",)).filter(field("s_acctbal", DOUBLE).gt(0.0))
    first = scope.first()
    return spark.createDataFrame([(scope.count(), scope.exists(), first["s_suppkey"] if first else None)], "n long, some boolean, first long")


# --- merges ---------------------------------------------------------------------

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
KEY = ("o_orderkey",)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _state(orders: DataFrame) -> DataFrame:
    return m.resident(orders.where("o_orderkey % 2 = 0"), epoch=F.col("o_orderkey"))


def _items(orders: DataFrame) -> DataFrame:
    """Every third order, twice: the later one (seq) has the higher price."""
    some = orders.where("o_orderkey % 3 = 0")
    again = lambda n: some.withColumns({"o_totalprice": F.col("o_totalprice") + n, "seq": F.lit(n)})
    return again(1).unionByName(again(2))


def _dead(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderkey % 5 = 0").select("o_orderkey")


def _delta(spark: SparkSession, sf_dir: str, **options) -> m.Merge:
    orders = _orders(spark, sf_dir)
    return m.apply_delta(_state(orders), _items(orders), _dead(orders), keys=KEY, now=NOW, seq=F.col("seq"), **options)


MERGED = """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 5 <> 0"""


@query(MERGED)
def delta_apply_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir).state.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) AS applied_items, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 5 = 0) AS tombstones_evicted, 0::BIGINT AS lru_evictions, 0::BIGINT AS backend_reserved_skips FROM orders""")
def delta_apply_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir).stats()


@query("""SELECT phase, o_orderkey, kind, reason, old_price, new_price, row_number() OVER (ORDER BY phase, o_orderkey) - 1 AS pos FROM (
  SELECT 0 AS phase, o_orderkey, 'invalidate' AS kind, 'on_delete' AS reason, o_totalprice AS old_price, NULL::DOUBLE AS new_price FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 = 0
  UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'insert' END, NULL, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, o_totalprice + 2 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)""")
def delta_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _delta(spark, sf_dir, policy=m.UPDATE).events.select("phase", "o_orderkey", "kind", "reason", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))
    return Scope(events, ("phase", "o_orderkey")).numbered()


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 5 <> 0""")
def delta_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir, policy=m.REJECT).state.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"""SELECT o_orderkey, e FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1000000000 ELSE o_orderkey END AS e FROM ({MERGED})) ORDER BY e DESC, o_orderkey LIMIT 100""")
def delta_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir, lru_size=100, epoch=1_000_000_000).state.select("o_orderkey", F.col("_epoch").alias("e"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def refresh_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return m.refresh_upsert(_state(orders), _items(orders), keys=KEY, now=NOW, seq=F.col("seq")).state.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice + 2 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def refresh_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return m.refresh_replace(_state(orders), _items(orders), keys=KEY, now=NOW, seq=F.col("seq")).state.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, 'manual' AS reason FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def refresh_replace_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    events = m.refresh_replace(_state(orders), _items(orders), keys=KEY, now=NOW, seq=F.col("seq")).events
    return events.where("kind = 'invalidate'").select("o_orderkey", "reason")


@query("SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) AS inserted, count(*) FILTER (o_orderkey % 6 = 0) AS updated, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0) AS removed FROM orders")
def restore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return m.restore_counts(_state(orders), orders.where("o_orderkey % 3 = 0"), keys=KEY, now=NOW)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0")
def invalidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return m.apply_delta(_state(orders), orders.limit(0), orders.where("o_orderkey % 7 = 0"), keys=KEY, now=NOW).state.select("o_orderkey")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 500")
def lru_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = m.resident(table(spark, sf_dir, "events").select("event_id", "ts"), epoch=F.unix_micros(F.col("ts").cast("timestamp")))
    return m.capped(state, 500, NOW, ("event_id",))[0].select("event_id")


def _deadlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, datetime]:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    middle = events.where("event_id % 2 = 0").agg(F.max("ts")).first()[0].replace(tzinfo=timezone.utc) - timedelta(days=3)
    return m.resident(events, expires_at=F.when(F.col("event_id") % 4 != 0, F.col("ts"))), middle


@query("SELECT event_id FROM events, (SELECT max(ts) - INTERVAL 3 DAY AS now FROM events WHERE event_id % 2 = 0) WHERE event_id % 4 = 0 OR ts > now")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, now = _deadlines(spark, sf_dir)
    return state.where(m.live(now)).select("event_id")


@query("SELECT event_id, 'ttl_expired' AS reason FROM events, (SELECT max(ts) - INTERVAL 3 DAY AS now FROM events WHERE event_id % 2 = 0) WHERE event_id % 4 <> 0 AND ts <= now")
def ttl_sweep_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, now = _deadlines(spark, sf_dir)
    return m.purge_expired(state, now, ("event_id",)).events.select("event_id", "reason")


@query("""SELECT c_custkey, c_name, 'pool' AS src FROM customer, (SELECT unnest([0, 1]) AS d) WHERE c_custkey % 4 = 0 AND c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name, 'source' FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 2 = 0""")
def fetch_many_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    ids = customer.where("c_custkey % 2 = 0").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).select("c_custkey", (F.col("c_custkey") * 2 + F.col("d")).alias("_ord"))
    found = m.fetch_many(ids, m.resident(customer.where("c_custkey % 4 = 0")), customer, ("c_custkey",), NOW)
    return found.select("c_custkey", "c_name", F.col("_from").alias("src"))


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 1""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    state = m.resident(customer.where("c_custkey % 3 <> 1"))
    return m.merge(state, customer.withColumn("c_acctbal", F.col("c_acctbal") + 1), keys=("c_custkey",), now=NOW, policy=m.REJECT).state.select("c_custkey", "c_acctbal")


# --- cursors, snapshots, keys, models ---------------------------------------------

@query("""WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), e AS (SELECT 1 AS tick, lo + (hi - lo) / 4 AS e FROM b UNION ALL SELECT 2, lo + (hi - lo) / 2 FROM b UNION ALL SELECT 3, hi FROM b),
c AS (SELECT tick, e, (SELECT max(ts) FROM events WHERE ts <= e) AS cursor FROM e),
r AS (SELECT c.tick, c.e, c.cursor, p.cursor AS since FROM c LEFT JOIN c p ON p.tick = c.tick - 1)
SELECT r.tick, count(*) AS n, epoch_us(max(r.cursor)) AS cursor FROM r JOIN events ON ts <= e AND (since IS NULL OR ts >= since) GROUP BY r.tick""")
def delta_cursor_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    r = events.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    at = lambda us: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)
    ticks = cursor_ticks(events, "ts", [at(r["lo"] + (r["hi"] - r["lo"]) // 4), at(r["lo"] + (r["hi"] - r["lo"]) // 2), at(r["hi"])])
    return reduce(DataFrame.union, (rows.agg(F.lit(i + 1).alias("tick"), F.count("*").alias("n"), F.lit(cursor).alias("c")).select("tick", "n", F.unix_micros("c").alias("cursor")) for i, (rows, cursor) in enumerate(ticks)))


@query("""WITH l AS (SELECT event_id, ts, user_id, now FROM events, (SELECT max(ts) - INTERVAL 3 DAY AS now FROM events WHERE event_id % 2 = 0) WHERE event_id % 4 = 0 OR ts > now)
SELECT event_id, dense_rank() OVER (ORDER BY user_id) - 1 AS lru_rank, CASE WHEN event_id % 4 <> 0 THEN (epoch_us(ts) - epoch_us(now)) // 1000 END AS remaining_ms FROM l""")
def snapshot_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, now = _deadlines(spark, sf_dir)
    users = table(spark, sf_dir, "events").select("event_id", "user_id")
    # The ranks are of the live rows' epochs; here an epoch is a user's id.
    state = state.drop("_epoch").join(users, "event_id").withColumnRenamed("user_id", "_epoch")
    return snapshot.hints(state, now).select("event_id", "lru_rank", "remaining_ms")


@query(f"SELECT n_nationkey, lower(hex(encode(n_name))) AS id_hex, '{keyspace('eu', 'app.Nation')}' AS space FROM nation")
def keyspace_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", hex_key(F.col("n_name")).alias("id_hex"), F.lit(keyspace("eu", "app.Nation")).alias("space"))


PARTY = Trait("party", T.StructType([T.StructField("id", LONG), T.StructField("name", STRING), T.StructField("balance", DOUBLE)]))


def _model(name: str, prefix: str, key: str) -> Model:
    return Model(name, T.StructType([T.StructField(f"{prefix}_{key}", LONG), T.StructField(f"{prefix}_name", STRING), T.StructField(f"{prefix}_acctbal", DOUBLE)]), key=f"{prefix}_{key}")


CUSTOMER, SUPPLIER = _model("customer", "c", "custkey"), _model("supplier", "s", "suppkey")


@PARTY.implements(CUSTOMER)
def _customer() -> dict[str, Column]:
    return {"id": F.col("c_custkey"), "name": F.col("c_name"), "balance": F.col("c_acctbal")}


@PARTY.implements(SUPPLIER)
def _supplier() -> dict[str, Column]:
    return {"id": F.col("s_suppkey"), "name": F.col("s_name"), "balance": F.col("s_acctbal")}


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PARTY.union({model.name: model.check(table(spark, sf_dir, model.name)) for model in (CUSTOMER, SUPPLIER)}, spark)


@query("SELECT 'customer' AS model, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier")
def cross_type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir).withColumnRenamed("_model", "model")


@query("SELECT 'customer' AS model, count(*) AS n, min(c_name) AS sample FROM customer UNION ALL SELECT 'supplier', count(*), min(s_name) FROM supplier")
def cross_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.trait_stats(_parties(spark, sf_dir).withColumnRenamed("name", "label")).withColumnRenamed("_model", "model")


# --- example analytics --------------------------------------------------------------

@query("SELECT l_returnflag AS team, count(*) AS shots, sum((l_linestatus = 'F')::BIGINT)::BIGINT AS goals, sum(round(l_discount * 1000)::BIGINT)::BIGINT AS xg_milli FROM lineitem GROUP BY l_returnflag")
def team_summary_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.team_summary(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("team"), (F.col("l_linestatus") == "F").alias("goal"), F.col("l_discount").alias("xg")))


@query("""SELECT least(greatest(round((42 - y)::FLOAT / 84::FLOAT * 6::FLOAT)::INTEGER, 0), 6) AS "row", least(greatest(round((x + 100)::FLOAT / 200::FLOAT * 10::FLOAT)::INTEGER, 0), 10) AS col, least(count(*), 65535)::INTEGER AS n
FROM (SELECT (event_id % 230 - 110)::INTEGER AS x, (user_id % 100 - 50)::INTEGER AS y FROM events) WHERE x BETWEEN -100 AND 100 AND y BETWEEN -42 AND 42 GROUP BY 1, 2""")
def heatmap_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select((F.col("event_id") % 230 - 110).cast("int").alias("x"), (F.col("user_id") % 100 - 50).cast("int").alias("y"))
    return shots.heatmap(points, 11, 7)


@query("SELECT p_partkey, regexp_matches(translate(CASE WHEN p_partkey % 3 = 0 THEN 'a One' WHEN p_partkey % 3 = 1 THEN 'ONE - ' ELSE p_name END || CASE WHEN p_partkey % 2 = 0 THEN '-Timer!' ELSE 'timers' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])one[^a-z0-9]+timer([^a-z0-9]|$)') AS adjacent, p_brand || ' #' || p_partkey AS label, printf('%.2f avg', p_retailprice) AS price FROM part")
def token_match_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat(F.when(F.col("p_partkey") % 3 == 0, "a One").when(F.col("p_partkey") % 3 == 1, "ONE - ").otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 2 == 0, "-Timer!").otherwise("timers"))
    adjacent = shots.one_timer(kind)
    return table(spark, sf_dir, "part").select("p_partkey", adjacent.alias("adjacent"), F.format_string("%s #%d", "p_brand", "p_partkey").alias("label"), F.format_string("%.2f avg", "p_retailprice").alias("price"))
