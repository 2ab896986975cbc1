"""Order-insensitive content identity of a table.

Each row becomes one unambiguous text, its SHA-256 is cut into 32-bit lanes, and
the lanes are summed. A sum (unlike xor) counts duplicates; it does not depend on
row order, partitioning or retries, and partial aggregation makes it one number
per task before anything is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F, types as T

LANES = 4


def _value_text(name: str, dtype: T.DataType) -> Column:
    column = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(dtype, T.BinaryType):
        return F.hex(column)
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(column)), {"ignoreNullFields": "false"})
    if isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # -0.0 and 0.0 compare equal, so they must not differ here.
        return F.when(column == 0, F.lit("0.0")).otherwise(column.cast("string"))
    return column.cast("string")


def row_text(schema: T.StructType) -> Column:
    """Length-prefixed values joined by commas; a null is ``~``.

    The length prefix keeps a value that contains the separator from reading as
    two values, and keeps null apart from the empty string.
    """
    parts = []
    for field in schema.fields:
        text = _value_text(field.name, field.dataType)
        size = F.octet_length(text).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), text), F.lit("~")))
    return F.concat_ws(",", *parts)


def row_digest(schema: T.StructType) -> Column:
    return F.sha2(row_text(schema), 256)


def lane(digest: Column, index: int) -> Column:
    """Lane ``index`` of a hex digest as a decimal that cannot overflow when summed."""
    piece = F.substring(digest, 8 * index + 1, 8)
    return F.conv(piece, 16, 10).cast("decimal(20,0)")


def lane_sums(digest: Column) -> list[Column]:
    return [F.sum(lane(digest, i)).alias(f"lane{i}") for i in range(LANES)]


def fingerprint(df: DataFrame, by: list[str] | None = None, over: list[str] | None = None) -> DataFrame:
    """Row count and lane sums of the ``over`` columns (all), whole or per ``by`` group."""
    keyed = df.withColumn("_digest", row_digest(df.select(*over).schema if over else df.schema))
    grouped = keyed.groupBy(*(by or []))
    return grouped.agg(F.count(F.lit(1)).alias("rows"), *lane_sums(F.col("_digest")))


def _column_types(schema: T.StructType) -> str:
    return ";".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)


def identity(rows: int, lanes: list, schema: T.StructType) -> str:
    """One hex identity from the row count, the summed lanes and the column types."""
    text = "|".join([str(rows), *[str(int(v or 0)) for v in lanes], _column_types(schema)])
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def identity_column(schema: T.StructType) -> Column:
    """:func:`identity` over the columns that :func:`fingerprint` returns."""
    lanes = [F.coalesce(F.col(f"lane{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(LANES)]
    return F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *lanes, F.lit(_column_types(schema))), 256)


def table_identity(df: DataFrame) -> str:
    return fingerprint(df).select(identity_column(df.schema)).first()[0]
