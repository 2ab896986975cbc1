"""Per-feature two-group linear models with moderated t-statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tails import digamma, digamma_column, t_p_value, trigamma_column, trigamma_inverse
from ..plans import staged
from .tests_of_means import adjust_p_values, two_group_moments


def treatment_design(df: DataFrame, factor: str, levels: Sequence[str]) -> DataFrame:
    """Intercept and one 0/1 column per non-reference level.

    ``levels[0]`` is the reference. A value outside ``levels`` gives a row of nulls.
    """
    known = F.col(factor).isin(list(levels))
    columns = {"intercept": F.when(known, F.lit(1.0))}
    for level in levels[1:]:
        columns[f"{factor}{level}"] = F.when(known, (F.col(factor) == level).cast("double"))
    return df.withColumns(columns)


def fit_two_groups(long: DataFrame, feature: str, value: str, group: str, levels: tuple[str, str]) -> DataFrame:
    """Least-squares fit of ``value ~ group`` for each feature.

    ``levels`` is (reference, other); ``log_fc`` is other minus reference.
    """
    moments = two_group_moments(long, value, group, levels, [feature])
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    residual = n1 + n2 - 2
    return moments.filter((F.col("n1") > 0) & (F.col("n2") > 0)).select(
        feature,
        (F.col("mean2") - F.col("mean1")).alias("log_fc"),
        ((n1 * F.col("mean1") + n2 * F.col("mean2")) / (n1 + n2)).alias("ave_expr"),
        residual.alias("df_residual"),
        ((F.col("ss1") + F.col("ss2")) / F.nullif(residual, F.lit(0.0))).alias("s2"),
        F.sqrt(1 / n1 + 1 / n2).alias("stdev_unscaled"),
    )


@dataclass(frozen=True)
class VariancePrior:
    """Scaled inverse chi-square prior of the feature variances."""

    df: float
    s2: float
    df_total_limit: float


def variance_prior(fit: DataFrame) -> VariancePrior:
    """Moment estimates from the log variances (Smyth 2004): a few sums over features."""
    usable = fit.filter((F.col("df_residual") > 0) & F.col("s2").isNotNull())
    middle = usable.agg(F.percentile_approx("s2", 0.5, F.lit(10000)), F.sum("df_residual"), F.avg("s2")).first()
    if middle[0] is None:
        raise ValueError("no feature has residual degrees of freedom, so no variance can be estimated")
    # Exact zero variances would have no logarithm.
    floor = 1e-5 * (middle[0] if middle[0] > 0 else 1.0)
    half = F.col("df_residual") / 2
    e = F.log(F.greatest("s2", F.lit(floor))) - digamma_column(half) + F.log(half)
    mean_e, var_e, noise = usable.select(e.alias("e"), trigamma_column(half).alias("q")).agg(
        F.avg("e"), F.var_samp("e"), F.avg("q")
    ).first()
    spread = (var_e or 0.0) - noise
    if spread > 0:
        df0 = 2 * trigamma_inverse(spread)
        s20 = math.exp(mean_e + float(digamma(np.array([df0 / 2]))[0]) - math.log(df0 / 2))
    else:
        df0, s20 = math.inf, middle[2]
    return VariancePrior(df0, s20, middle[1])


def moderate(fit: DataFrame, prior: VariancePrior | None = None) -> DataFrame:
    """Shrink the variances to the prior and add ``t``, ``df_total``, ``p_value``."""
    prior = prior or variance_prior(fit)
    residual = F.col("df_residual")
    if math.isinf(prior.df):
        s2_post, df_total = F.lit(prior.s2), F.lit(prior.df_total_limit)
    else:
        own = F.coalesce(F.col("s2") * residual, F.lit(0.0))
        s2_post = (F.lit(prior.df * prior.s2) + own) / (residual + prior.df)
        df_total = F.least(residual + prior.df, F.lit(prior.df_total_limit))
    t = F.col("log_fc") / F.nullif(F.sqrt(s2_post) * F.col("stdev_unscaled"), F.lit(0.0))
    return fit.withColumns({"s2_post": s2_post, "t": t, "df_total": df_total}).withColumn(
        "p_value", t_p_value(F.col("t"), F.col("df_total"))
    )


def top_table(long: DataFrame, feature: str, value: str, group: str, levels: tuple[str, str]) -> DataFrame:
    """Fit, moderate and adjust all features; most significant first."""
    fitted = staged(fit_two_groups(long, feature, value, group, levels))
    tested = staged(moderate(fitted))
    columns: list[str | Column] = [feature, "log_fc", "ave_expr", "t", "p_value", "adj_p_value"]
    return adjust_p_values(tested, "p_value").select(*columns).orderBy("p_value", feature)
