"""Typed exchange keeps values or raises with the column's name."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabletrail.operators import exchange
from tabletrail.operators.exchange import ExchangeError


def test_carried_types(spark):
    rows = [(1, 1.5, True, "a", dt.date(2020, 1, 2)), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i bigint, f double, b boolean, s string, d date")
    out = exchange.to_exchange(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "double", "boolean", "string", "date"]
    assert out.collect() == rows


def test_wide_integers_become_double_as_a_whole(spark):
    df = spark.createDataFrame([(1, 1, 2**31 - 1, -(2**31)), (2**40, None, -(2**31) + 1, 0)], "big bigint, small bigint, edge bigint, low int")
    out = exchange.to_exchange(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["double", "int", "int", "double"]
    assert out.collect()[1][0] == float(2**40)


def test_names_stay_verbatim(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a b` int, `x-y` int, `p.q` int")
    assert exchange.to_exchange(df).columns == ["a b", "x-y", "p.q"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "array<int>", "struct<a: int>", "decimal(5,1)", "binary"])
def test_unsupported_types_name_the_column(spark, kind):
    with pytest.raises(ExchangeError, match="'when'"):
        exchange.to_exchange(spark.createDataFrame([], f"ok int, `when` {kind}"))


def test_nan_and_null_are_one(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert exchange.to_exchange(df).filter("x is null").count() == 2
    assert exchange.from_exchange(df).filter("x is null").count() == 2


def test_factors_and_dates_return_as_labels_and_dates(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 18262.0), (None, None), (3, float("nan"))], "g int, d double")
    out = exchange.from_exchange(df, dates=("d",), factors={"g": ["lo", "hi"]})
    assert [tuple(r) for r in out.collect()] == [("lo", dt.date(1970, 1, 1)), ("hi", dt.date(2020, 1, 1)), (None, None), (None, None)]


def test_factor_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "g string")
    coded, levels = exchange.factor_codes(df, "g", "code")
    assert sorted((r["g"] or "", r["code"]) for r in coded.collect() if r["g"]) == [("a", 1), ("b", 2), ("b", 2)]
    assert coded.filter("g is null and code is null").count() == 1
    assert [tuple(r) for r in levels.orderBy("code").select("code", "g").collect()] == [(1, "a"), (2, "b")]


LISTS = {
    "ints": ([("integer", "1"), ("null", None)], "integer"),
    "wide": ([("integer", "1"), ("integer", str(2**40))], "double"),
    "mixed numbers": ([("integer", "1"), ("double", "2.5")], "double"),
    "bools": ([("boolean", "true"), ("null", None)], "boolean"),
    "bool beside number": ([("boolean", "true"), ("integer", "1")], "list"),
    "strings": ([("string", "a"), ("null", None)], "string"),
    "string and number": ([("string", "a"), ("integer", "1")], "list"),
    "nothing": ([("null", None), ("null", None)], "boolean"),
    "nested": ([("nested", "[1]"), ("integer", "1")], "list"),
    "one": ([("integer", "-7")], "integer"),
}


def test_vector_types(spark):
    rows = [(name, t, v) for name, (items, _) in LISTS.items() for t, v in items]
    elements = spark.createDataFrame(rows, "list_id string, type string, value string")
    got = {r["list_id"]: r["vector_type"] for r in exchange.vector_types(elements).collect()}
    assert got == {name: kind for name, (_, kind) in LISTS.items()}
    typed = exchange.typed_elements(elements).toPandas()
    assert set(typed[typed.list_id == "wide"].as_double) == {1.0, float(2**40)}
    assert list(typed[typed.is_scalar].list_id) == ["one"] and list(typed[typed.list_id == "one"].as_integer) == [-7]


def test_named_and_positional_lists(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2]), (["a", ""], [1, 2]), (None, [3])], "n array<string>, v array<int>")
    out = df.select(exchange.named_list(F.col("n"), F.col("v")).alias("m"), exchange.positional_list(F.col("n"), F.col("v")).alias("p")).collect()
    assert [r["m"] for r in out] == [{"a": 1, "b": 2}, None, None]
    assert [r["p"] for r in out] == [None, [1, 2], [3]]
    twice = spark.createDataFrame([(["a", "a"], [1, 2])], df.schema)
    with pytest.raises(PySparkException, match="DUPLICATED_MAP_KEY"):
        twice.select(exchange.named_list(F.col("n"), F.col("v"))).collect()


def test_nested_records(spark):
    df = spark.createDataFrame([('{"name": "x", "scores": [90.5, 85.0], "meta": {"id": 7}}',), ('{"name": null, "scores": []}',)], "j string")
    rows = exchange.parse_nested(df, "j").select("parsed.name", "parsed.meta.id", F.size("parsed.scores").alias("n")).collect()
    assert [tuple(r) for r in rows] == [("x", 7, 2), (None, None, 0)]
    mixed = spark.createDataFrame([('{"v": true}',), ('{"v": 1}',)], "j string")
    assert exchange.parse_nested(mixed, "j").schema["parsed"].dataType["v"].dataType.simpleString() == "variant"


def test_user_code(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "g string, v bigint")

    def centred(batch):
        return batch.assign(c=batch.v - batch.v.mean())[["g", "c"]]

    out = exchange.map_groups(df, ["g"], centred, "g string, c double")
    assert sorted(map(tuple, out.collect())) == [("a", -1.0), ("a", 1.0), ("b", 0.0)]
    many = spark.range(1_200_000).selectExpr("'x' AS g", "id % 2 AS v")
    assert exchange.map_groups(many, ["g"], centred, "g string, c double").groupBy("c").count().count() == 2
    with pytest.raises(ExchangeError, match="'t'"):
        exchange.map_table(df, lambda b: b, "t timestamp")
