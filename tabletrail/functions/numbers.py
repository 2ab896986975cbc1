"""Null-aware arithmetic, integer range tests and array layout expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: usable range of a 32-bit integer whose lowest code means NA ---
INT32_MIN = -(2**31) + 1
INT32_MAX = 2**31 - 1
# ---------------------------------------------------------------------------------


def fits_int32(value: Column) -> Column:
    return value.between(INT32_MIN, INT32_MAX)


def is_missing(value: Column, floating: bool = True) -> Column:
    return value.isNull() | F.isnan(value) if floating else value.isNull()


def missing_to_null(value: Column) -> Column:
    """NaN and null are one missing value."""
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null where the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def minus_log10(p: Column) -> Column:
    return -F.log10(p)


def label_if(condition: Column, yes: str, no: str) -> Column:
    """Two-way label that stays null where the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)


def column_major_index(*axes: tuple[Column, int]) -> Column:
    """Position of a cell in a column-major flattening; axes are (index, extent)."""
    position, stride = F.lit(0).cast("bigint"), 1
    for index, extent in axes:
        position = position + index * F.lit(stride)
        stride *= extent
    return position


def column_major_cell(position: Column, extents: list[int]) -> list[Column]:
    """Inverse of :func:`column_major_index`: one index column per extent."""
    cells, stride = [], 1
    for extent in extents:
        cells.append(F.pmod(F.floor(position / F.lit(stride)), F.lit(extent)).cast("bigint"))
        stride *= extent
    return cells


def level_label(levels: Column, code: Column) -> Column:
    """Label of a 1-based category code; null code or unknown code gives null."""
    return F.when(code >= 1, F.try_element_at(levels, code.cast("int")))


def scalar_or_array(values: Column) -> tuple[Column, Column]:
    """(scalar, array): a one-element vector becomes its element."""
    single = F.size(values) == 1
    return F.when(single, F.element_at(values, 1)), F.when(~single, values)


def replace_record(records: Column, key: str, record: Column) -> Column:
    """Array of structs with the entry of the same ``key`` replaced, sorted by key."""
    kept = F.filter(records, lambda r: r[key] != record[key])
    return F.sort_array(F.concat(kept, F.array(record)))
