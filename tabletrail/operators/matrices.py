"""Matrices as long tables: reshaping, alignment, row z-scores, distances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numbers import column_major_cell, column_major_index, missing_to_null
from ..plans import lookup
from .exchange import ExchangeError
from .summaries import first_match, group_moments

# Positions per block of the distance job: 512 x 512 doubles are 2 MiB per task.
DISTANCE_BLOCK = 512


def long_from_wide(df: DataFrame, feature: str, samples: Sequence[str] | None = None, *, sample_name: str = "sample", value_name: str = "value") -> DataFrame:
    """One row per (feature, sample) from one column per sample."""
    columns = list(samples) if samples is not None else [c for c in df.columns if c != feature]
    return df.unpivot([feature], columns, sample_name, value_name)


def wide_from_long(df: DataFrame, feature: str, sample: str, value: str, samples: Sequence, *, rest: str | None = None) -> DataFrame:
    """One column per sample, for the listed samples (a wide table needs a schema).

    Of several values for one cell the largest holds, whatever order they come in.
    ``rest`` names a column for the values of all other samples, missing ones too;
    without it they are left out.
    """
    listed = F.coalesce(F.col(sample).isin(list(samples)), F.lit(False))
    cells = [F.max(F.when(F.col(sample) == F.lit(s), F.col(value))).alias(str(s)) for s in samples]
    others = [F.max(F.when(~listed, F.col(value))).alias(rest)] if rest is not None else []
    return df.groupBy(feature).agg(*cells, *others)


def long_from_arrays(df: DataFrame, row: str, values: str, *, column_name: str = "j", value_name: str = "value") -> DataFrame:
    """One row per array element, positions from 0."""
    kind = df.schema[values].dataType
    if not isinstance(kind, T.ArrayType):
        raise ExchangeError(f"column {values!r} has type {kind.simpleString()}, not an array; use long_from_wide() for columns")
    return df.select(row, F.posexplode(values).alias(column_name, value_name))


def vector_from_matrix(df: DataFrame, value: str, axes: Sequence[tuple[str, int]], name: str = "k") -> DataFrame:
    """Column-major flattening: position ``k`` and value per cell."""
    position = column_major_index(*[(F.col(c), extent) for c, extent in axes])
    return df.select(position.alias(name), F.col(value))


def matrix_from_vector(df: DataFrame, position: str, value: str, axes: Sequence[tuple[str, int]]) -> DataFrame:
    """Re-impose dimensions on a column-major vector."""
    cells = column_major_cell(F.col(position), [extent for _, extent in axes])
    return df.select(*[c.alias(n) for c, (n, _) in zip(cells, axes)], F.col(value))


def complete_matrix(df: DataFrame, value: str) -> DataFrame:
    """The cells as they are, or an error when one that is not a float is missing.

    Only floating point values have a NaN to stand for a missing cell.
    """
    floating = isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType))
    if not floating and not df.filter(F.col(value).isNull()).isEmpty():
        raise ExchangeError(f"{value!r} has missing cells, which its type cannot express in a matrix; cast it to double or keep it as a table")
    return df


def align_samples(matrix: DataFrame, phenotype: DataFrame, sample: str = "sample", position: str | None = None) -> DataFrame:
    """Keep samples known to both sides and attach the phenotype.

    With ``position`` the first phenotype record of a sample wins; without it the
    phenotype must already hold one record per sample.
    """
    if position is not None:
        phenotype = first_match(phenotype, sample, position).drop(position)
    return lookup(matrix, phenotype, [sample], "inner")


def row_zscores(long: DataFrame, feature: str, value: str, *, epsilon: float = 1e-9) -> DataFrame:
    """Add ``z``: deviation from the feature mean over (population sd + epsilon)."""
    moments = group_moments(long, feature, value)
    z = (missing_to_null(F.col(value)) - F.col("_mean")) / (F.col("_sd") + F.lit(epsilon))
    attached = lookup(long, moments, [feature], rename={"mean": "_mean", "sd_pop": "_sd"}, weight="n_rows")
    return attached.withColumn("z", z).drop("_mean", "_sd")


def position_distances(df: DataFrame, values: str, width: int, *, block: int = DISTANCE_BLOCK) -> DataFrame:
    """Euclidean distance between every two array positions, over all rows.

    ``df`` holds one array of ``width`` numbers per observation, i.e. the columns
    of a matrix. Each task sums squared differences for one pair of position
    blocks over its own rows and emits that partial matrix once; no pair of rows
    is ever formed and memory does not grow with the number of rows.
    """
    starts = range(0, width, block)
    partials = [
        _block_partials(df, values, width, a, min(block, width - a), b, min(block, width - b))
        for a in starts for b in starts if a <= b
    ]
    merged = partials[0]
    for partial in partials[1:]:
        merged = merged.unionByName(partial)
    return merged.groupBy("i", "j").agg(F.sqrt(F.sum("ss")).alias("distance"))


def _block_partials(df: DataFrame, values: str, width: int, a: int, a_len: int, b: int, b_len: int) -> DataFrame:
    # Checked in the same pass; a short row would otherwise fail inside numpy.
    whole = F.when(F.size(values) == width, F.col(values)).otherwise(
        F.raise_error(F.lit(f"column {values!r} must hold arrays of {width} numbers in every row"))
    )
    left = F.slice(whole, a + 1, a_len).cast("array<double>").alias("left")
    right = F.slice(whole, b + 1, b_len).cast("array<double>").alias("right")
    sides = ["left"] if a == b else ["left", "right"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((a_len, b_len))
        for batch in batches:
            x, y = (np.stack(batch[side].to_numpy()) for side in (sides[0], sides[-1]))
            for i in range(a_len):
                difference = y - x[:, i : i + 1]
                total[i] += np.einsum("rj,rj->j", difference, difference)
        i, j = np.meshgrid(np.arange(a, a + a_len), np.arange(b, b + b_len), indexing="ij")
        keep = i < j
        yield pd.DataFrame({"i": i[keep], "j": j[keep], "ss": total[keep]})

    columns = [left] if a == b else [left, right]
    return df.select(*columns).mapInPandas(sums, "i bigint, j bigint, ss double")
