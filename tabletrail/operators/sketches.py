"""Quantiles from mergeable sketches: a state per group and part, kept with a table and merged later.

The exact quantiles of :mod:`plots` read all rows. A sketch of each part of a table, made
while it is published, answers for any union of parts, tables or runs without reading
them again, with a known error of rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import missing_to_null
from .plots import QUARTILES, WHISKER_REACH

# --- fixed values: the size of a KLL sketch, the largest there may be, and the constants
# of its published error of rank at 99 % confidence
SIZE = 4096
LARGEST = 65_535
ERROR = (2.296, 0.9021)
# ------------------------------------------------------------------------------------


def rank_error(size: int = SIZE) -> float:
    """How far the rank of an estimated quantile may be from the asked one, as a share of the rows."""
    factor, power = ERROR
    return factor / size**power


def quantile_states(df: DataFrame, by: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """``by, n, low, high, state``: count, extremes and sketch of the present values of each group."""
    present = missing_to_null(F.col(value).cast("double"))
    rows = df.select(*by, present.alias("_v"))
    state = F.kll_sketch_agg_double("_v", F.lit(size))
    return rows.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), state.alias("state"))


def merged_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of fewer, larger groups: those of many parts, tables or runs as one."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("state").alias("state"))


def estimated(state: Column, probability: float) -> Column:
    return F.kll_sketch_get_quantile_double(state, F.lit(float(probability)))


def estimated_boxes(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, n, low, q1, median, q3, high, whisker_low, whisker_high``: boxes from states.

    Each quartile is within ``rank_error``; ``low`` and ``high`` are exact. Whiskers end at
    their reach or at the extremes, whichever is nearer. A group without present values
    has ``n`` 0 and no quantiles.
    """
    names = dict(zip(("q1", "median", "q3"), QUARTILES))
    merged = merged_states(states, by)
    boxes = merged.withColumns({name: F.when(F.col("n") > 0, estimated(F.col("state"), q)) for name, q in names.items()})
    reach = (F.col("q3") - F.col("q1")) * WHISKER_REACH
    ends = {"whisker_low": F.greatest(F.col("q1") - reach, F.col("low")), "whisker_high": F.least(F.col("q3") + reach, F.col("high"))}
    some = F.col("n") > 0
    return boxes.select(*by, "n", "low", "q1", "median", "q3", "high", *[F.when(some, end).alias(name) for name, end in ends.items()])
