"""Typed exchange: coerce tables and nested values to a small set of types, or refuse.

The target types are boolean, 32-bit integer, double, string and date. Missing
numbers (NaN or null) become one null. A type outside the set raises with the
column's name instead of being guessed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numbers import INT32_MAX, INT32_MIN, level_label, missing_to_null
from ..functions.text import base_type
from ..plans import lookup

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_PLAIN = (T.BooleanType, T.StringType, T.VarcharType, T.CharType, T.DateType)


class ExchangeError(TypeError):
    """A value or column has no counterpart on the other side."""


def _col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def refusal(kind: T.DataType) -> str | None:
    """What to do with a column of a type that does not cross; None for one that does."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return "flatten it first (matrices go through matrix operators, records through nested ones)"
    if isinstance(kind, (*_INTEGERS, *_FLOATS, *_PLAIN)):
        return None
    return "cast it to a string, a number or a date first"


def check_exchangeable(schema: T.StructType) -> None:
    for field in schema.fields:
        hint = refusal(field.dataType)
        if hint is not None:
            raise ExchangeError(f"column {field.name!r} has type {field.dataType.simpleString()}, which does not cross; {hint}")


def exchange_report(df: DataFrame) -> DataFrame:
    """``name, base, rows, missing, refusal`` of every column: what an exchange would refuse, without raising.

    ``base`` is the type's name without its parameters. One aggregate over the table.
    """
    facts = [
        F.struct(
            F.lit(f.name).alias("name"), base_type(F.lit(f.dataType.simpleString().replace("<", "("))).alias("base"), F.count(F.lit(1)).alias("rows"),
            F.count_if(_missing(f)).alias("missing"), F.lit(refusal(f.dataType)).cast("string").alias("refusal"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*facts).alias("_f")).select(F.explode("_f").alias("_f")).select("_f.*")


def _missing(field: T.StructField):
    column = _col(field.name)
    return column.isNull() | F.isnan(column) if isinstance(field.dataType, _FLOATS) else column.isNull()


def to_exchange(df: DataFrame) -> DataFrame:
    """The table in exchange types, column names kept verbatim.

    An integer column becomes 32-bit, or double as a whole when any value needs
    more. One aggregate over all integer columns decides that.
    """
    check_exchangeable(df.schema)
    wide = wide_integer_columns(df)
    columns = []
    for field in df.schema.fields:
        column = _col(field.name)
        if isinstance(field.dataType, _INTEGERS):
            column = column.cast("double" if field.name in wide else "int")
        elif isinstance(field.dataType, _FLOATS):
            column = missing_to_null(column.cast("double"))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def wide_integer_columns(df: DataFrame) -> set[str]:
    """Integer columns holding a value outside the 32-bit range."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    names += [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegerType)]
    if not names:
        return set()
    extremes = [f(_col(n)).alias(f"{side}{i}") for i, n in enumerate(names) for side, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(*extremes).first()
    wide = set()
    for i, name in enumerate(names):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if low is not None and (low < INT32_MIN or high > INT32_MAX):
            wide.add(name)
    return wide


def from_exchange(df: DataFrame, *, dates: tuple[str, ...] = (), factors: dict[str, list[str]] | None = None) -> DataFrame:
    """Undo codes on the way back: day numbers to dates, 1-based codes to labels, NaN to null."""
    for field in df.schema.fields:
        column = _col(field.name)
        if field.name in dates:
            # Infinite and missing day numbers have no date.
            finite = missing_to_null(column.cast("double"))
            df = df.withColumn(field.name, F.date_from_unix_date(F.floor(finite).try_cast("int")))
        elif factors and field.name in factors:
            levels = F.array(*[F.lit(level) for level in factors[field.name]])
            df = df.withColumn(field.name, level_label(levels, column))
        elif isinstance(field.dataType, _FLOATS):
            df = df.withColumn(field.name, missing_to_null(column))
    return df


def factor_codes(df: DataFrame, column: str, code: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a 1-based ``code``, levels table), levels in sorted order."""
    from ..plans import row_numbers

    present = df.select(column).filter(_col(column).isNotNull()).distinct()
    levels = row_numbers(present, [_col(column)], code)
    return lookup(df, levels, [column]), levels


def decode_factor(df: DataFrame, code: str, levels: DataFrame, label: str) -> DataFrame:
    """Replace codes by labels through a levels table (code, label)."""
    return lookup(df, levels, [code]).drop(code) if label in levels.columns else df


# --- user code over a table ----------------------------------------------------


def map_table(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches of the exchange form; rows may be processed in any split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    result = to_exchange(df).mapInPandas(run, schema)
    check_exchangeable(result.schema)
    return result


def map_groups(df: DataFrame, by: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to each whole group.

    The function needs its group in the memory of one task, whatever the size. What can
    be said as an aggregate, or over any split of the rows (:func:`map_table`), should be.
    """
    result = to_exchange(df).groupBy(*by).applyInPandas(fn, schema)
    check_exchangeable(result.schema)
    return result


# --- nested values ----------------------------------------------------------------


def vector_types(elements: DataFrame, list_id: str = "list_id", kind: str = "type", value: str = "value") -> DataFrame:
    """The vector type of each list from its elements' types.

    ``type`` is one of boolean, integer, double, string, null or nested. Numbers
    mix; a boolean beside a number, or any other mixture, stays a ``list``. All
    missing is boolean, as in R. An integer beyond 32 bits makes the list double.
    """
    is_kind = {k: F.count_if(F.col(kind) == k) for k in ("boolean", "integer", "double", "string", "null")}
    fits = F.coalesce(F.expr(f"try_cast(`{value}` as int)").between(INT32_MIN, INT32_MAX), F.lit(False))
    wide = F.count_if((F.col(kind) == "integer") & ~fits)
    seen = elements.groupBy(list_id).agg(
        F.count(F.lit(1)).alias("length"), wide.alias("_wide"), *[c.alias(f"_{k}") for k, c in is_kind.items()]
    )
    present = F.col("length") - F.col("_null")
    numbers = F.col("_integer") + F.col("_double")
    vector = (
        F.when(present == 0, "boolean")
        .when(F.col("_boolean") == present, "boolean")
        .when((F.col("_integer") == present) & (F.col("_wide") == 0), "integer")
        .when(numbers == present, "double")
        .when(F.col("_string") == present, "string")
        .otherwise("list")
    )
    return seen.select(list_id, "length", vector.alias("vector_type"))


def typed_elements(elements: DataFrame, list_id: str = "list_id", kind: str = "type", value: str = "value") -> DataFrame:
    """Elements with their list's vector type and one typed column per type.

    A list of length one is marked ``is_scalar``.
    """
    typed = lookup(elements, vector_types(elements, list_id, kind, value), [list_id], weight="length")

    def as_type(name: str, sql_type: str):
        return F.when(F.col("vector_type") == name, F.expr(f"try_cast(`{value}` as {sql_type})"))

    return typed.withColumns(
        {
            "as_boolean": as_type("boolean", "boolean"),
            "as_integer": as_type("integer", "int"),
            "as_double": missing_to_null(as_type("double", "double")),
            "as_string": as_type("string", "string"),
            "is_scalar": F.col("length") == 1,
        }
    )


def named_list(names, values):
    """Map of a fully named list, else null; see :func:`positional_list`. Duplicate names raise."""
    fully = (F.size(names) == F.size(values)) & F.forall(names, lambda n: n.isNotNull() & (n != ""))
    return F.when(fully, F.map_from_arrays(names, values))


def positional_list(names, values):
    """Values by position when at least one name is missing, else null."""
    fully = (F.size(names) == F.size(values)) & F.forall(names, lambda n: n.isNotNull() & (n != ""))
    return F.when(~fully | names.isNull(), values)


def parse_nested(df: DataFrame, column: str, name: str = "parsed") -> DataFrame:
    """Parse a JSON column into structs and arrays, with one schema for all rows.

    The schema is aggregated over the whole column. Where rows disagree (a
    boolean beside a number, say) the field stays a variant and is not coerced.
    Text that is not JSON gives null; the text itself stays in its column.
    """
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        raise ExchangeError(f"column {column!r} has type {kind.simpleString()}, not JSON text")
    parsed = F.try_parse_json(column)
    ddl = df.agg(F.expr(f"schema_of_variant_agg(try_parse_json(`{column}`))")).first()[0]
    spark_type = ddl.replace("OBJECT<", "STRUCT<")
    return df.withColumn(name, F.variant_get(parsed, "$", spark_type))
