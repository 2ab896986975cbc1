"""Name -> (Spark query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Tables:
    """Lazy access to the tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of one query share."""
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]


REGISTRY: dict[str, Entry] = {}


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        REGISTRY[fn.__name__] = Entry(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return register
