"""Row numbers and running aggregates over a total order, without one big task.

``orderBy`` range-partitions and sorts. The sorted rows are staged together with
``monotonically_increasing_id``, whose upper bits number the sorted block and
whose lower bits number the row inside it. One small aggregate per block then
turns block-local results into global ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import lookup
from .staging import staged

_BLOCK_BITS = 33


def _blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed = staged(df.orderBy(*order).withColumn("_seat", F.monotonically_increasing_id()))
    return placed.withColumn("_block", F.shiftright("_seat", _BLOCK_BITS))


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows 1..n along ``order`` (make the order total for repeatable ties)."""
    placed = _blocks(df, order)
    # One row per sorted block, so the unpartitioned window below is bounded by
    # the number of shuffle partitions.
    sizes = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_seat").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))
    return (
        lookup(placed, starts, ["_block"], "inner")
        .withColumn(name, F.col("_start") + inside + 1)
        .drop("_seat", "_block", "_start")
    )


class Ordered:
    """A table in a total order, split by ``within``, that can be scanned cumulatively.

    Feed it pre-aggregated rows: one row per distinct (within, order) key. Then no
    single value, however frequent, is more than one row here.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], within: Sequence[str] = ()):
        self.within = list(within)
        self.order = list(order)
        self.df = _blocks(df, [*[F.col(c) for c in self.within], *self.order])

    def total(self, value: str, name: str) -> "Ordered":
        """Add the running sum of ``value``, current row included."""
        return self._scan(value, name, F.sum, lambda own, prior: own + F.coalesce(prior, F.lit(0)))

    def minimum(self, value: str, name: str) -> "Ordered":
        """Add the running minimum of ``value``, current row included."""
        return self._scan(value, name, F.min, lambda own, prior: F.least(own, prior))

    def with_column(self, name: str, value: Column) -> "Ordered":
        return self._wrap(self.df.withColumn(name, value))

    def result(self) -> DataFrame:
        return self.df.drop("_seat", "_block")

    def _wrap(self, df: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.within, other.order, other.df = self.within, self.order, df
        return other

    def _scan(self, value, name, aggregate, merge) -> "Ordered":
        key = ["_block", *self.within]
        per_block = self.df.groupBy(*key).agg(aggregate(value).alias("_own"))
        # At most one row per block for each split, so this window stays small.
        earlier = Window.partitionBy(*self.within).orderBy("_block")
        earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
        prior = per_block.select(*key, aggregate("_own").over(earlier).alias("_prior"))
        inside = Window.partitionBy(*key).orderBy("_seat")
        inside = inside.rowsBetween(Window.unboundedPreceding, 0)
        joined = lookup(self.df, prior, key)
        scanned = joined.withColumn(name, merge(aggregate(value).over(inside), F.col("_prior"))).drop("_prior")
        return self._wrap(scanned)
