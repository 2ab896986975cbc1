"""What several corpus operators share: word rules, staged tables, measured joins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabletrail.plans.staging import new_scratch, staged

# ASCII white space separates words, anything else belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# A side is broadcast only below both limits, measured after it was written.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a scale folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder; the lineage ends there."""
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text, unchanged and in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def measured(df: DataFrame) -> DataFrame:
    """``df`` staged, with a broadcast hint if its measured size allows one."""
    table = staged(df)
    return F.broadcast(table) if table._rows <= BROADCAST_ROWS and table._bytes <= BROADCAST_BYTES else table


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` at most in the jobs run inside; the session's own setting returns afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
