"""Two-sample t-tests from grouped moments, and p-value adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import missing_to_null
from ..functions.tails import t_p_value
from ..plans import Ordered, lookup


def two_group_moments(df: DataFrame, value: str, group: str, levels: tuple, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and sum of squares around the mean for each of two levels.

    One aggregation with partial merging; the groups never meet in one task.
    """
    present = missing_to_null(F.col(value).cast("double"))
    aggregates = []
    for i, level in enumerate(levels, start=1):
        mine = F.when(F.col(group) == F.lit(level), present)
        aggregates += [
            F.count(mine).alias(f"n{i}"),
            F.avg(mine).alias(f"mean{i}"),
            F.coalesce(F.var_pop(mine) * F.count(mine), F.lit(0.0)).alias(f"ss{i}"),
        ]
    return df.groupBy(*by).agg(*aggregates)


def _n(i: int) -> Column:
    return F.col(f"n{i}").cast("double")


def _sample_var(i: int) -> Column:
    return F.col(f"ss{i}") / F.nullif(_n(i) - 1, F.lit(0.0))


def t_test(df: DataFrame, value: str, group: str, levels: tuple, by: Sequence[str] = (), *, equal_var: bool = True, p_values: bool = True) -> DataFrame:
    """Two-sample t-test of ``levels[0]`` against ``levels[1]`` per ``by`` group.

    ``equal_var`` pools the variances; otherwise Welch's test with the
    Satterthwaite degrees of freedom. ``t``, ``df`` and ``p_value`` are null where
    the test is undefined.
    """
    moments = two_group_moments(df, value, group, levels, by)
    difference = F.col("mean1") - F.col("mean2")
    if equal_var:
        dof = _n(1) + _n(2) - 2
        pooled = (F.col("ss1") + F.col("ss2")) / F.nullif(dof, F.lit(0.0))
        error2 = pooled * (1 / F.nullif(_n(1), F.lit(0.0)) + 1 / F.nullif(_n(2), F.lit(0.0)))
    else:
        a = _sample_var(1) / F.nullif(_n(1), F.lit(0.0))
        b = _sample_var(2) / F.nullif(_n(2), F.lit(0.0))
        error2 = a + b
        parts = a * a / F.nullif(_n(1) - 1, F.lit(0.0)) + b * b / F.nullif(_n(2) - 1, F.lit(0.0))
        dof = error2 * error2 / F.nullif(parts, F.lit(0.0))
    tested = moments.select(
        *by, "n1", "n2", "mean1", "mean2",
        (difference / F.nullif(F.sqrt(error2), F.lit(0.0))).alias("t"),
        F.when(error2.isNotNull(), dof).alias("df"),
    )
    return tested.withColumn("p_value", t_p_value(F.col("t"), F.col("df"))) if p_values else tested


def adjust_p_values(df: DataFrame, p: str, name: str = "adj_p_value") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values; missing p-values stay missing.

    Works on the distinct p-values with their counts. In descending order the
    rank is the total minus the running count of larger values, and the
    adjustment is a running minimum; both are exact over any number of values.
    """
    value = missing_to_null(F.col(p).cast("double"))
    distinct = df.select(value.alias("_p")).filter("_p is not null").groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    table = Ordered(distinct, [F.col("_p").desc()])
    total = table.df.agg(F.sum("_n")).first()[0] or 0
    rank = F.lit(total) - F.col("_after") + F.col("_n")
    adjusted = (
        table.total("_n", "_after")
        .with_column("_raw", F.col("_p") * F.lit(float(total)) / rank)
        .minimum("_raw", "_low")
        .result()
        .select("_p", "_n", F.least(F.col("_low"), F.lit(1.0)).alias(name))
    )
    return lookup(df.withColumn("_p", value), adjusted, ["_p"], rename={name: name}, weight="_n").drop("_p")
