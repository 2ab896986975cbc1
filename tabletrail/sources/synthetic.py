"""Seeded example tables. Noise is a function of the row key, not of the partition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def normal_noise(seed: int, *key: Column) -> Column:
    """Standard normal value for a key (Box-Muller on two hashed uniforms)."""
    def uniform(stream: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *key), 11)
        return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(2))


def grouped_normals(spark: SparkSession, means: dict[str, float], per_group: int, *, seed: int = 42) -> DataFrame:
    """``group, value, group_code``: ``per_group`` unit-variance normals per group mean."""
    names = F.array(*[F.lit(g) for g in means])
    shifts = F.array(*[F.lit(float(m)) for m in means.values()])
    slot = (F.floor(F.col("id") / F.lit(per_group)) + 1).cast("int")
    rows = spark.range(per_group * len(means)).withColumn("slot", slot)
    return rows.select(
        F.element_at(names, F.col("slot")).alias("group"),
        (F.element_at(shifts, F.col("slot")) + normal_noise(seed, F.col("id"))).alias("value"),
        F.upper(F.substring(F.element_at(names, F.col("slot")), 1, 3)).alias("group_code"),
    )


def expression_matrix(
    spark: SparkSession, features: int, groups: Sequence[str], *, mean: float = 8.0, sd: float = 1.5,
    shifted: int = 20, effect: float = 2.0, effect_sd: float = 0.5, seed: int = 123,
) -> DataFrame:
    """``feature, sample, group, value``: the first ``shifted`` features differ in the last group."""
    samples = len(groups)
    cell = spark.range(features * samples).select(F.floor(F.col("id") / samples).alias("f"), F.pmod("id", F.lit(samples)).alias("s"))
    group = F.element_at(F.array(*[F.lit(g) for g in groups]), (F.col("s") + 1).cast("int"))
    base = F.lit(mean) + F.lit(sd) * normal_noise(seed, F.col("f"), F.col("s"))
    extra = F.lit(effect) + F.lit(effect_sd) * normal_noise(seed + 1, F.col("f"), F.col("s"))
    moved = (F.col("f") < shifted) & (group == groups[-1])
    width = len(str(samples - 1))
    return cell.select(
        F.format_string("FEATURE_%03d", "f").alias("feature"),
        F.format_string(f"S%0{max(width, 2)}d", "s").alias("sample"),
        group.alias("group"),
        F.when(moved, base + extra).otherwise(base).alias("value"),
    )
