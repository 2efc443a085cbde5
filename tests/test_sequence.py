"""Ordered pipelines."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolwright.functions.predicate import Field
from poolwright.operators.sequence import Scope

SCHEMA = "id long, age long, score int, team string"
AGE, TEAM = Field("age", T.LongType(), False), Field("team", T.StringType(), False)


def scope(spark, rows):
    return Scope(spark.createDataFrame(rows, SCHEMA), ("id",))


def ids(s):
    return [r["id"] for r in s.collect()]


def test_eight_steps(spark):
    s = scope(spark, [(1, 30, 2, "sales"), (2, 17, 3, "sales"), (3, 40, 1, "ops")])
    more = [dict(id=1, age=99, score=99, team="sales"), dict(id=4, age=22, score=0, team="ops")]
    s = s.filter(AGE.gte(18)).map(score=F.col("score") + 10).flat_map({}).chain(more).unique().sort_by_key("score").skip(1).take(1)
    assert [(r["id"], r["score"]) for r in s.collect()] == [(3, 11)]
    assert s.count() == 1 and s.exists() and s.first()["id"] == 3 and [r["id"] for r in s.iter()] == [3]


def test_opaque_steps_give_the_same(spark):
    s = scope(spark, [(1, 30, 2, "sales"), (2, 17, 3, "sales"), (3, 40, 1, "ops")])
    more = [dict(id=1, age=99, score=99, team="sales"), dict(id=4, age=22, score=0, team="ops")]
    s = s.filter(lambda r: r["age"] >= 18).map(lambda r: {**r, "score": r["score"] + 10}).flat_map(lambda r: [r]).chain(more).unique_by("id").sort(lambda a, b: a["score"] - b["score"]).skip(1).take(1)
    assert [(r["id"], r["score"]) for r in s.collect()] == [(3, 11)]


def test_group_partition_fold(spark):
    s = scope(spark, [(1, 30, 1, "sales"), (2, 22, 2, "ops"), (3, 34, 3, "sales"), (4, 41, 4, "ops")]).group_by("team")
    assert ids(s) == [1, 3, 2, 4]
    s = s.partition(TEAM.eq("ops"))
    assert ids(s) == [2, 4, 1, 3]
    assert ids(s.fold_max("age")) == [4]
    assert ids(s.fold(lambda rows: max(rows, key=lambda r: r["age"]))) == [4]
    assert ids(s.fold(lambda rows: None)) == []
    assert [tuple(r) for r in s.fold(score=F.sum("score")).collect()] == [(2, 22, 10, "ops")]


def test_chain_and_duplicates(spark):
    s = scope(spark, [(1, 1, 1, "a")])
    rows = [dict(id=99, age=1, score=1, team="b"), dict(id=100, age=1, score=1, team="b"), dict(id=99, age=1, score=1, team="b")]
    assert ids(s.chain(rows)) == [1, 99, 100, 99]
    assert ids(s.chain(rows).unique()) == [1, 99, 100]
    assert ids(s.chain(spark.createDataFrame([(7, 1, 1, "c"), (5, 1, 1, "c")], SCHEMA))) == [1, 5, 7]
    assert ids(s) == [1]
    assert ids(s.chain(rows).chain([rows[0]]).skip(3)) == [99, 99]


def test_stability_nulls_and_ties(spark):
    s = scope(spark, [(1, 5, 3, "x"), (2, 5, None, "x"), (3, 4, 3, "y"), (4, 5, None, None)])
    assert ids(s.sort_by_key("score")) == [2, 4, 1, 3]
    assert ids(s.sort_by_key("age").sort_by_key("score")) == [2, 4, 3, 1]
    assert ids(s.group_by("team")) == [1, 2, 3, 4]
    assert ids(s.unique_by("team")) == [1, 3, 4]
    assert ids(s.fold_max("age")) == [4] and ids(s.fold_max("age", last=False)) == [1] and ids(s.fold_min("age")) == [3]
    assert ids(s.filter(lambda r: 1 / (r["score"] - 3) > 0)) == []
    assert ids(s.partition(lambda r: r["team"].startswith("y"))) == [3, 1, 2, 4]
    assert [r["pos"] for r in s.sort_by_key("score").numbered().collect()] == [0, 1, 2, 3]


def test_empty(spark):
    s = scope(spark, []).group_by("team").partition(TEAM.eq("x")).sort_by_key("age")
    assert ids(s) == [] and s.first() is None and not s.exists() and s.count() == 0
    assert ids(s.fold(score=F.sum("score"))) == [] and ids(s.fold_max("age")) == [] and ids(s.fold(lambda rows: rows[0])) == []


def test_flat_map_columns(spark):
    s = scope(spark, [(1, 1, 1, "a"), (2, 2, 2, "b")]).flat_map({}, {"score": F.col("score") * 10, "_when": F.col("id") == 2}, {"score": F.lit(0)})
    assert [(r["id"], r["score"]) for r in s.collect()] == [(1, 1), (1, 0), (2, 2), (2, 20), (2, 0)]


def test_slices_that_follow_each_other_are_one(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    scope = Scope(rows, ("k",)).sort_by_key(-F.col("k"))
    for steps in ([("skip", 5), ("take", 10)], [("take", 30), ("skip", 5), ("take", 10)], [("skip", 2), ("skip", 3), ("take", 20), ("take", 10)], [("take", 3), ("skip", 9)], [("skip", 98)]):
        s, want = scope, list(range(99, -1, -1))
        for name, n in steps:
            s = getattr(s, name)(n)
            want = want[n:] if name == "skip" else want[:n]
        assert [r["k"] for r in s.collect()] == want
    plan = scope.skip(5).take(10).rows()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=15, offset=5" in plan
