"""The pinned text dialect: the gate must agree with the actual round trip."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from tabletrail.functions.fingerprint import table_identity
from tabletrail.sources.textformat import reader, unrestorable_columns, write

MOMENT = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
CASES = [
    ("bigint", 2**40, True), ("int", -5, True), ("double", 1e-300, True), ("string", "x", True), ("boolean", False, True),
    ("date", dt.date(1970, 1, 2), True), ("timestamp_ntz", MOMENT, True), ("timestamp", MOMENT, True), ("decimal(10,2)", Decimal("1.20"), True),
    ("array<bigint>", [1], False), ("struct<a: int>", (1,), False), ("map<string,int>", {"a": 1}, False), ("binary", bytearray(b"\x00\xff"), False),
]


@pytest.mark.parametrize(("kind", "value", "restorable"), CASES)
def test_gate_agrees_with_round_trip(spark, tmp_path, kind, value, restorable):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    assert (unrestorable_columns(df.schema, "csv") == []) is restorable
    try:
        write(df, str(tmp_path / "t"), "csv")
        same = reader(spark, df.schema, "csv").load(str(tmp_path / "t")).collect() == df.collect()
    except Exception:
        same = False
    assert same is restorable


def test_parquet_takes_nested_types(spark):
    schema = T._parse_datatype_string("a array<bigint>, s struct<a: int>, m map<string,int>, b binary, t timestamp_ntz")
    accepted = {f.name for f in schema.fields} - {name for name, _ in unrestorable_columns(schema, "parquet")}
    assert {"b", "t"} <= accepted


@pytest.mark.parametrize("partitions", [1, 3])
def test_difficult_texts_and_numbers(spark, tmp_path, partitions):
    texts = [None, "", " padded ", '"quoted"', 'a,"b"', "line\nbreak", "cr\rcr", "crlf\r\n", "tab\t", "NaN", "null", "\\", "\\n", "'", "é漢"]
    numbers = [1e-300, 4.2e-8, 0.1 + 0.2, -0.0, float("inf"), None, 5e-324]
    rows = [(i, t, numbers[i % len(numbers)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, x double").repartition(partitions)
    write(df, str(tmp_path / "t"), "csv")
    back = reader(spark, df.schema, "csv").load(str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert table_identity(back) == table_identity(df)
    assert not [p for p in (tmp_path / "t").iterdir() if p.name == "_SUCCESS"]


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "a bigint, d date")
    for fmt in ("csv", "parquet"):
        write(df, str(tmp_path / fmt), fmt)
        back = reader(spark, df.schema, fmt).load(str(tmp_path / fmt))
        assert back.count() == 0 and [f.dataType for f in back.schema] == [f.dataType for f in df.schema]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_identity_ignores_order_and_partitioning(spark, partitions):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("t"), (F.col("id") / 7).alias("x"))
    assert table_identity(df.repartition(partitions).sort(F.desc("t"))) == table_identity(df)


def test_identity_sees_every_difference(spark):
    def one(rows, schema="a string, b string"):
        return table_identity(spark.createDataFrame(rows, schema))

    tables = [
        one([("x", "y")]), one([("x", "y"), ("x", "y")]), one([("x,1:y", None)]), one([(None, "x")]), one([("x", None)]), one([("x", "")]),
        one([("", "x")]), one([("x", "y")], "a string, c string"), one([]), one([("xy", "")]),
    ]
    assert len(set(tables)) == len(tables)
    maps = [table_identity(spark.sql(q)) for q in ("SELECT map('a', 1, 'b', 2) m", "SELECT map('b', 2, 'a', 1) m")]
    assert maps[0] == maps[1]
