"""Group statistics, top counts, de-duplication and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import label_if, missing_to_null
from ..plans import lookup, row_numbers, staged


def summarize_batches(measurements: DataFrame) -> DataFrame:
    """Rows, mean intensity and strongest p-value per batch and group, sorted."""
    return (
        measurements.groupBy("batch", "group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("intensity"), 4).alias("mean_intensity"),
            F.min("p_value").alias("min_p"),
        )
        .orderBy("group", "batch")
    )


def rank_by_significance(measurements: DataFrame) -> DataFrame:
    """Measurements by ascending p-value; equal p-values by sample."""
    columns = ("sample_id", "batch", "group", "intensity", "p_value")
    return measurements.select(*columns).orderBy("p_value", "sample_id")


def significance_ranks(measurements: DataFrame) -> DataFrame:
    """The ranking as an explicit ``rank`` column, for tables too big to keep in order."""
    columns = ("sample_id", "batch", "group", "intensity", "p_value")
    order = [F.col(c) for c in ("p_value", "sample_id", "batch", "group", "intensity")]
    return row_numbers(measurements.select(*columns), order)


def top_counts(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values; equal counts in value order."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column).limit(n)


def head_by(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows of an ordering (a per-task top-n, merged)."""
    return df.orderBy(*order).limit(n)


def group_moments(df: DataFrame, group: str | Sequence[str], value: str) -> DataFrame:
    """Rows, present values, mean, sample sd and population sd per group."""
    keys = [group] if isinstance(group, str) else list(group)
    present = missing_to_null(F.col(value))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(present).alias("n"),
        F.avg(present).alias("mean"),
        F.stddev_samp(present).alias("sd"),
        F.stddev_pop(present).alias("sd_pop"),
    )


def group_zscores(df: DataFrame, group: str, value: str, *, cutoff: float = 2.0, skip_missing: bool = False) -> DataFrame:
    """Add ``z_score`` (sample sd) and ``is_outlier`` within each group.

    The moments are aggregated and attached, so a group is never gathered in one
    task. As in R, one missing value makes the whole group missing unless
    ``skip_missing``; a group of one row or without spread has no z-score.
    """
    moments = group_moments(df, group, value)
    if not skip_missing:
        whole = F.col("n") == F.col("n_rows")
        moments = moments.withColumns({c: F.when(whole, F.col(c)) for c in ("mean", "sd")})
    spread = F.nullif(F.col("sd"), F.lit(0.0))
    moments = moments.select(group, "n_rows", F.col("mean").alias("_mean"), spread.alias("_sd"))
    z = (missing_to_null(F.col(value)) - F.col("_mean")) / F.col("_sd")
    return (
        lookup(df, moments, [group], rename={"_mean": "_mean", "_sd": "_sd"}, weight="n_rows")
        .withColumn("z_score", z)
        .withColumn("is_outlier", F.abs("z_score") > cutoff)
        .drop("_mean", "_sd")
    )


def last_wins(df: DataFrame, key: Sequence[str] | str, sequence: Sequence[str] | str) -> DataFrame:
    """The latest record of each key; of equally late ones, any."""
    return _one_per_key(df, key, sequence, last=True)


def first_match(df: DataFrame, key: Sequence[str] | str, sequence: Sequence[str] | str) -> DataFrame:
    """The earliest record of each key, a missing place being the first; of equally early ones, any."""
    return _one_per_key(df, key, sequence, last=False)


def _one_per_key(df: DataFrame, key, sequence, last: bool) -> DataFrame:
    """Narrow each key to its records at the outermost place, column by column of the order.

    A place is one number or time per key, so it is a hash aggregate merged in the map
    tasks. Records themselves are neither sorted nor gathered, only compared with it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows, order = df, [sequence] if isinstance(sequence, str) else list(sequence)
    for i, column in enumerate(order):
        # What the places so far have left, about one record a key, is written before it is read twice.
        rows = staged(rows) if i else rows
        missing_first = F.when(~F.bool_or(F.col(column).isNull()), F.min(column))
        place = staged(rows.groupBy(*keys).agg((F.max(column) if last else missing_first).alias("_place"), F.count(F.lit(1)).alias("_count")))
        rows = lookup(rows, place, keys, "inner", rename={"_place": "_place"}, weight="_count").filter(F.col(column).eqNullSafe(F.col("_place"))).drop("_place")
    return rows.dropDuplicates(keys)


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first occurrence, in that order."""
    return df.groupBy(value).agg(F.min(position).alias(position)).orderBy(position)


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical concatenation by column name."""
    first, *others = frames
    for frame in others:
        first = first.unionByName(frame)
    return first


def common_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).intersect(right.select(column))


def difference(left: DataFrame, right: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return left.join(right, on, "left_anti")


def significance_calls(df: DataFrame, p: str = "adj_p_value", effect: str = "log_fc", *, alpha: float = 0.05, min_effect: float = 1.0) -> DataFrame:
    """Add the ``sig`` label of a volcano plot."""
    called = (F.col(p) < alpha) & (F.abs(effect) > min_effect)
    return df.withColumn("sig", label_if(called, "Significant", "Not Sig"))


def with_palette(df: DataFrame, column: str, palette: dict[str, str], name: str = "color") -> DataFrame:
    """Look a category up in a palette given as a plain dictionary."""
    pairs = [F.lit(x) for item in palette.items() for x in item]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(column)))


def enrich(rows: DataFrame, attributes: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Equi-join on a shared column name.

    Without hints Spark broadcasts a side only when its measured size is small,
    and adaptive execution splits the partitions of hot keys.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}; use 'inner' or 'left'")
    return rows.join(attributes, on, how)
