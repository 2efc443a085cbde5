"""Lookups and their combinations against a two-valued evaluator."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolwright.errors import ConfigError
from poolwright.functions.lower import condition, to_sql, total
from poolwright.functions.predicate import FALSE, TRUE, And, Field, Leaf, Not, Or, Xor, as_predicate, evaluate

USER = [dict(id=1, name="Alice", age=30, banned=False, nickname="Al"), dict(id=2, name="BOB", age=17, banned=True, nickname=None)]
ID, NAME, AGE = Field("id", T.LongType(), False), Field("name", T.StringType(), False), Field("age", T.LongType(), False)
BANNED, NICK = Field("banned", T.BooleanType(), False), Field("nickname", T.StringType())
YEAR = Field("year", T.IntegerType())


def holds(spark, rows, schema, p):
    """Ids of rows that match, by the filter and by the total column."""
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    kept = {r["id"] for r in df.where(condition(p)).collect()}
    assert kept == {r["id"] for r in df.where(total(p)).collect()}
    assert df.where(total(p).isNull()).count() == 0
    assert kept == {r["id"] for r in rows if evaluate(p, r)}
    return kept


@pytest.mark.parametrize("p,want", [
    (NAME.eq("Alice"), {1}), (NAME.neq("Alice"), {2}), (AGE.gt(17), {1}), (AGE.gte(17), {1, 2}), (AGE.lt(30), {2}), (AGE.lte(30), {1, 2}),
    (AGE.between(17, 30), {1, 2}), (AGE.between(30, 17), set()), (ID.in_([1, 3]), {1}), (ID.in_([]), set()), (ID.not_in([]), {1, 2}), (ID.not_in([1]), {2}),
    (NICK.is_null(), {2}), (NICK.is_not_null(), {1}), (NAME.contains("li"), {1}), (NAME.icontains("OB"), {2}), (NAME.starts_with("B"), {2}), (NAME.istarts_with("b"), {2}),
    (NAME.ends_with("e"), {1}), (NAME.iends_with("ob"), {2}), (NAME.iexact("bob"), {2}), (AGE.gte(18) & ~BANNED.eq(True), {1}), (BANNED.eq(True) | NAME.eq("Alice"), {1, 2}),
    (BANNED.eq(True) ^ AGE.lt(18), set()), (And(()), {1, 2}), (Or(()), set()), (TRUE & NAME.eq("BOB"), {2}), (FALSE | FALSE, set()), (NICK.eq(None), {2}), (NICK.neq("Al"), {2}),
])
def test_lookups(spark, p, want):
    assert holds(spark, USER, "id long, name string, age long, banned boolean, nickname string", p) == want


@pytest.mark.parametrize("p,want", [
    (YEAR.some().lte(2020), {2, 3}), (YEAR.eq(None), {1}), (YEAR.neq(2020), {1, 2, 4}), (YEAR.some().in_([1999, 2020]), {2, 3}), (YEAR.some().not_in([1999, 2020]), {4}), (YEAR.some().not_in([]), {2, 3, 4}),
    (YEAR.not_in([1999]), {1, 3, 4}), (YEAR.in_([None, 1999]), {1, 2}), (YEAR.some().between(1990, 2000), {2}), (YEAR.lt(2000), {1, 2}), (YEAR.lte(1999), {1, 2}), (YEAR.gte(None), {1, 2, 3, 4}), (YEAR.gt(None), {2, 3, 4}),
    (YEAR.lte(None), {1}), (YEAR.lt(None), set()), (YEAR.between(None, 1999), {1, 2}), (~YEAR.some().eq(1999), {1, 3, 4}), (YEAR.some().eq(1999) ^ YEAR.some().neq(1999), {2, 3, 4}),
])
def test_optional(spark, p, want):
    rows = [dict(id=1, year=None), dict(id=2, year=1999), dict(id=3, year=2020), dict(id=4, year=2022)]
    assert holds(spark, rows, "id long, year int", p) == want


def test_ascii_folding_only(spark):
    title = Field("title", T.StringType(), False)
    rows = [dict(id=i, title=t) for i, t in enumerate(["Alpha%_\\Trail", "Éclair", "éclair", "Café"])]
    schema = "id long, title string"
    assert holds(spark, rows, schema, title.iexact("éclair")) == {2}
    assert holds(spark, rows, schema, title.icontains("%_\\")) == {0}
    assert holds(spark, rows, schema, title.iends_with("FÉ")) == set()
    assert holds(spark, rows, schema, title.iends_with("Fé")) == {3}
    assert holds(spark, rows, schema, title.contains("")) == {0, 1, 2, 3}


def test_random_trees_agree(spark):
    """Null, NaN and both views under random combinations."""
    rnd = random.Random(7)
    rows = [dict(id=i, a=rnd.choice([None, 0, 1, 2, 3]), x=rnd.choice([0.0, -0.0, 1.5, math.nan, math.inf, -2.0]), y=rnd.choice([None, 1.5, math.nan, 0.0])) for i in range(60)]
    a, x, y = Field("a", T.IntegerType()), Field("x", T.DoubleType(), False), Field("y", T.DoubleType())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, a int, x double, y double").cache()

    def leaf():
        f = rnd.choice([a, x, y, a.some(), y.some()])
        values = [0, 1, 2] if f.name == "a" else [0.0, 1.5, math.nan, -2.0]
        if f.nullable and not f.present:
            values = [*values, None]
        op = rnd.choice(["eq", "neq", "gt", "gte", "lt", "lte", "in_", "not_in", "between"])
        if op in ("in_", "not_in"):
            return getattr(f, op)(rnd.sample(values, rnd.randint(0, 3)))
        return f.between(rnd.choice(values), rnd.choice(values)) if op == "between" else getattr(f, op)(rnd.choice(values))

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return leaf()
        kind = rnd.choice("&|^~")
        if kind == "~":
            return ~tree(depth - 1)
        left, right = tree(depth - 1), tree(depth - 1)
        return left & right if kind == "&" else left | right if kind == "|" else left ^ right

    trees = [tree(3) for _ in range(120)]
    got = df.select("id", *(total(p).alias(f"t{i}") for i, p in enumerate(trees))).collect()
    kept = [{r["id"] for r in df.where(condition(p)).select("id").collect()} for p in trees[:25]]
    for r in got:
        for i, p in enumerate(trees):
            assert r[f"t{i}"] == evaluate(p, rows[r["id"]]), (to_sql(p), rows[r["id"]])
    for i, ids in enumerate(kept):
        assert ids == {r["id"] for r in rows if evaluate(trees[i], r)}, to_sql(trees[i])


def test_structure():
    p, q, r = ID.eq(1), ID.eq(2), ID.eq(3)
    assert (p & q & r) == And((p, q, r)) and (p | (q | r)) == Or((p, q, r)) and (p ^ q) == Xor(p, q)
    assert ~~p == p and ~TRUE == FALSE and ~FALSE == TRUE and ~(p & q) == Not(And((p, q)))
    assert [x.field for x in (p & ~q).leaves()] == ["id", "id"] and isinstance(p, Leaf)
    assert (p.field, p.op, p.operand) == ("id", "eq", 1) and p.operand_as(int) == 1 and p.operand_as(str) is None

    class Named:
        def __as_predicate__(self):
            return p

    assert as_predicate(Named()) == p and (q & Named()) == And((q, p))
    with pytest.raises(TypeError):
        as_predicate(3)
    with pytest.raises(ConfigError):
        ID.some()
    with pytest.raises(ConfigError):
        NICK.contains("x")


def test_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    p = Field("o_totalprice", T.DoubleType()).some().lt(1000.0) & Field("o_orderstatus", T.StringType()).eq("O")
    plan = df.where(condition(p))._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThan(o_totalprice,1000.0)" in plan and "EqualTo(o_orderstatus,O)" in plan


def test_float_column_uses_its_own_type(spark):
    xg = Field("xg", T.FloatType(), False)
    df = spark.createDataFrame([(1, 0.15)], "id long, xg float")
    assert df.where(condition(xg.gte(0.15))).count() == 1 and df.where(F.col("xg") <= F.lit(0.15)).count() == 0
