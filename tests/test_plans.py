"""Joins and orderings must not depend on sizes, spread or partitioning."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabletrail.plans import Ordered, lookup, row_numbers, staged


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds most rows; one key is null; the rows repeat."""
    key = F.when(F.col("id") < 3000, 0).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50)
    return staged(spark.range(5000).select(key.alias("k"), (F.col("id") % 7).alias("v")))


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_the_same_broadcast_or_salted(skewed, limit, how):
    table = skewed.groupBy("k").agg(F.count("*").alias("n")).filter("k is null or k <> 3")
    got = lookup(skewed, table, ["k"], how, broadcast_rows=limit, flag="found").groupBy("k", "n", "found").count().toPandas()
    rows = skewed.toPandas()
    sizes = rows.groupby("k", dropna=False).size()
    for _, row in got.iterrows():
        same = sizes[sizes.index.isna()].iloc[0] if pd.isna(row["k"]) else sizes[row["k"]]
        assert row["count"] == same
        assert (row["n"] == same and row["found"]) if row["k"] != 3 else pd.isna(row["n"])
    assert (3 in set(got["k"])) == (how == "left")
    assert got["count"].sum() == (len(rows) if how == "left" else len(rows) - sizes[3])


def test_salted_lookup_spreads_the_hot_key(skewed):
    table = skewed.groupBy("k").agg(F.count("*").alias("n"))
    plan = lookup(skewed, table, ["k"], broadcast_rows=0)._jdf.queryExecution().toString()
    assert "_salt" in plan


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_row_numbers(spark, partitions):
    df = spark.range(2000).select(F.pmod(F.xxhash64("id"), F.lit(9)).alias("p"), "id").repartition(partitions)
    got = row_numbers(df, [F.col("p"), F.col("id")]).toPandas().sort_values("rank")
    want = got.sort_values(["p", "id"])
    assert list(got["rank"]) == list(range(1, 2001))
    assert list(got["id"]) == list(want["id"])


def test_running_aggregates(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100000)).alias("x")).distinct()
    scanned = Ordered(df, [F.col("x").desc()], ["g"]).total("x", "t").minimum("x", "m").result().toPandas()
    want = scanned.sort_values(["g", "x"], ascending=[True, False])
    assert list(want.groupby("g")["x"].cumsum()) == list(want["t"])
    assert list(want.groupby("g")["x"].cummin()) == list(want["m"])


def test_wide_lookup_rows_are_not_broadcast(spark, monkeypatch):
    from tabletrail.plans import joins

    rows = spark.range(100).withColumnRenamed("id", "k")
    table = rows.withColumn("text", F.repeat(F.lit("x"), 1000))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10_000)
    assert "ResolvedHint" not in lookup(rows, table, ["k"], unique=True)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1_000_000)
    assert "ResolvedHint" in lookup(rows, table, ["k"], unique=True)._jdf.queryExecution().analyzed().toString()


def test_staged_measures_and_empty_tables(spark):
    table = staged(spark.createDataFrame([("é", [1]), (None, None)], "s string, a array<int>"))
    assert table._rows == 2 and table._bytes == 2 * 16 + 2 + 3
    for empty in (spark.range(0).toDF("x"), spark.createDataFrame([], "x int"), spark.range(5).filter("id > 9")):
        assert staged(empty)._rows == 0 and staged(empty).count() == 0


def test_staged_tables_pass_through(spark):
    once = staged(spark.range(3).toDF("x"))
    assert staged(once) is once
    assert sorted(r[0] for r in once.collect()) == [0, 1, 2]
