"""JSON predicates: lowered columns against the plain evaluator."""

import json
import math

import pytest
from pyspark.sql import functions as F

from poolwright.errors import ConfigError, JsonValueError
from poolwright.functions.json import MISSING, JsonRef, as_variant, check_value, compare_exactly, deep_equal, parse
from poolwright.functions.lower import condition, total

ONE = '{"profile":{"age":30,"name":"Ada","content-type":"application/json","a.b":true,"0":"zero-key","":"empty-key","cafe":"ascii","cafe\\u0301":"unicode","q\\"":1},"scores":[1,2.0,"x"]}'
TWO = '{"present_null":null,"number":5,"array":[true]}'
THREE = '{"null":null,"bool":true,"number":5,"string":"value","array":[],"object":{}}'
FOUR = '{"big":18446744073709551615,"small":-9223372036854775808,"odd":9007199254740993,"half":0.5,"neg":-2.5,"zero":-0.0,"one":1.0,"huge":1e300}'
DOCS = [ONE, TWO, THREE, FOUR, None, "null", "3", "[1,[2,{\"a\":1.0}]]"]

J = JsonRef("j")
PROFILE = J.key("profile")
PREDICATES = [
    J.at("profile.age").value("u64").gte(30), PROFILE.key("content-type").value("string").eq("application/json"), PROFILE.key("a.b").value("bool").eq(True), PROFILE.key("0").value("string").eq("zero-key"),
    PROFILE.key("").exists(), PROFILE.key('q"').value("number").eq(1), PROFILE.segments("café").exists(), PROFILE.key("cafe").value("string").neq("unicode"), J.key("scores").array_contains(1), J.key("scores").array_contains(2),
    J.key("scores").array_contains("y"), J.key("scores").array_len_eq(3), J.key("scores").array_len_gt(3), J.key("scores").array_len_gte(3), J.key("scores").array_len_lt(3), J.key("scores").array_len_lte(2),
    J.key("present_null").exists(), J.key("present_null").missing(), J.key("present_null").is_json_null(), J.key("nowhere").missing(), J.key("number").is_not_json_null(), J.key("nowhere").is_not_json_null(),
    J.key("number").key("below").missing(), J.key("array").key("0").missing(), J.key("number").value("string").neq("5"), J.key("number").value("number").neq(6), J.key("nowhere").value("number").not_in([1]), J.key("number").value("number").not_in([]),
    J.key("number").value("number").in_([]), J.key("number").value("number").in_([4, 5.0]), J.key("number").value("number").between(5, 5.5), J.key("number").has_all_keys([]), J.has_all_keys([]), J.has_any_key([]), J.has_any_key(["number", "big"]), J.has_all_keys(["number", "array"]),
    *(J.key(k).is_type(k) for k in ("null", "bool", "number", "string", "array", "object")), J.is_object(), J.is_array(), J.exists(), J.missing(), J.is_json_null(), J.is_number(),
    J.eq_json(json.loads(TWO)), J.neq_json({"number": 5.0}), J.eq_json([1, [2.0, {"a": 1}]]), J.eq_json(3.0), J.neq_json(None), J.key("nowhere").neq_json(1), J.eq_json({}),
    J.key("big").value("number").eq((1 << 64) - 1), J.key("big").value("number").eq(float(1 << 64)), J.key("big").value("number").lt(float(1 << 64)), J.key("odd").value("number").gt(9007199254740992.0), J.key("odd").value("number").eq(9007199254740993),
    J.key("odd").value("number").lte(9007199254740992), J.key("half").value("number").gt(0), J.key("half").value("number").lt(1), J.key("half").value("number").neq(0), J.key("neg").value("number").between(-3, -2), J.key("zero").value("number").eq(0),
    J.key("one").value("number").eq(1), J.key("small").value("number").eq(-(1 << 63)), J.key("small").value("number").gte(-1e19), J.key("huge").value("number").gt((1 << 64) - 1), J.key("half").value("number").lt((1 << 53) + 1),
    ~J.key("nowhere").value("number").eq(1), J.key("number").value("number").eq(5) ^ J.key("bool").value("bool").eq(True),
]


def test_lowered_agrees_with_evaluator(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, t string").withColumn("j", as_variant(F.col("t")))
    got = df.select("id", *(total(p).alias(f"p{i}") for i, p in enumerate(PREDICATES))).collect()
    from poolwright.functions.predicate import evaluate

    for r in got:
        row = {"j": MISSING if DOCS[r["id"]] is None else parse(DOCS[r["id"]])}
        for i, p in enumerate(PREDICATES):
            assert r[f"p{i}"] == evaluate(p, row), (DOCS[r["id"]], p)
    for p in PREDICATES[::9]:
        assert df.where(condition(p)).count() == df.where(total(p)).count()


def test_values():
    assert parse('{"a":1,"b":2,"a":3}') == {"a": 3, "b": 2} and list(parse('{"a":1,"b":2,"a":3}')) == ["a", "b"]
    assert deep_equal({"a": 1, "b": [1.0]}, {"b": [1], "a": 1.0}) and not deep_equal(True, 1) and deep_equal(0.0, -0.0) and not deep_equal((1 << 64) - 1, float((1 << 64) - 1))
    for bad in (math.nan, math.inf, 1 << 64, -(1 << 63) - 1, {1: 2}, object()):
        with pytest.raises(JsonValueError):
            check_value(bad)
    for bad in ("NaN", "Infinity"):
        with pytest.raises(JsonValueError):
            parse(bad)


def test_building():
    with pytest.raises(ConfigError):
        J.at("a.b-c")
    with pytest.raises(ConfigError):
        J.at("a." + "x" * 64)
    with pytest.raises(ConfigError):
        J.key("a").value("string").gt("x")
    with pytest.raises(JsonValueError):
        J.key("a").value("f64").eq(math.inf)
    with pytest.raises(JsonValueError):
        J.key("a").value("number").eq("1")
    p = J.at("profile.age").value("number").gte(18)
    assert (p.field, p.path, p.op, p.operand) == ("j", ("profile", "age"), "gte", 18)


def test_exact_compare(spark):
    ints = [-(1 << 63), -(1 << 63) + 1, -1, 0, 1, (1 << 53) + 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    floats = [-1e19, -9223372036854775808.0, -0.5, 0.0, 0.5, 9007199254740992.0, 9007199254740994.0, 9223372036854775808.0, 18446744073709549568.0, 18446744073709551616.0]
    rows = [(str(i), f) for i in ints for f in floats]
    got = spark.createDataFrame(rows, "i string, f double").select("i", "f", compare_exactly(F.col("i").cast("decimal(20,0)"), F.col("f")).alias("c")).collect()
    assert all(r["c"] == (int(r["i"]) > r["f"]) - (int(r["i"]) < r["f"]) for r in got)
