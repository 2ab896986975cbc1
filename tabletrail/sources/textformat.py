"""The pinned CSV dialect, and which column types survive it."""

from __future__ import annotations

import datetime as dt
import decimal

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, types as T

from ..plans.staging import new_scratch

# --- fixed values: one dialect for every text table, so that equal content is
# written as equal text and null, "", quotes, newlines and padding all survive ---
NULL_TEXT = "\\N"
_COMMON = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "encoding": "UTF-8",
    "nullValue": NULL_TEXT,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "dateFormat": "yyyy-MM-dd",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
WRITE_OPTIONS = {**_COMMON, "emptyValue": '""'}
READ_OPTIONS = {**_COMMON, "emptyValue": "", "multiLine": "true", "mode": "FAILFAST"}
# ----------------------------------------------------------------------------------

FORMATS = ("parquet", "csv")


def reader(spark: SparkSession, schema: T.StructType, fmt: str) -> DataFrameReader:
    base = spark.read.schema(schema).format(fmt)
    return base.options(**READ_OPTIONS) if fmt == "csv" else base


def write(df: DataFrame, path: str, fmt: str, *, max_records_per_file: int = 0) -> None:
    """Write part files only; the success marker would be a file nobody recorded."""
    writer = df.write.format(fmt).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if fmt == "csv":
        writer = writer.options(**WRITE_OPTIONS)
    writer.save(path)


# A value per simple type that a lossy text format would change.
_SAMPLES = {
    T.BooleanType: True,
    T.ByteType: -7,
    T.ShortType: -7,
    T.IntegerType: -7,
    T.LongType: -(2**40),
    T.FloatType: 0.5,
    T.DoubleType: 1e-300,
    T.StringType: ' "a,b"\n ',
    T.BinaryType: bytearray(b"\x00\xff"),
    T.DateType: dt.date(1999, 12, 31),
    T.TimestampType: dt.datetime(1999, 12, 31, 23, 59, 59, 123456),
    T.TimestampNTZType: dt.datetime(1999, 12, 31, 23, 59, 59, 123456),
}


def _sample(dtype: T.DataType):
    if isinstance(dtype, T.DecimalType):
        return decimal.Decimal(7).scaleb(-dtype.scale) if dtype.precision else None
    if isinstance(dtype, T.DayTimeIntervalType):
        return dt.timedelta(days=3, hours=4) if dtype.startField != dtype.endField else None
    return _SAMPLES.get(type(dtype))


# Verdicts already reached: (type, format) -> survives.
_VERDICTS: dict[tuple[str, str], bool] = {}


def _round_trip(spark: SparkSession, dtypes: list[T.DataType], fmt: str) -> list[bool]:
    """Write one value of each type in one row, read it back, compare."""
    schema = T.StructType([T.StructField(f"c{i}", d) for i, d in enumerate(dtypes)])
    values = [_sample(d) for d in dtypes]
    path = new_scratch(spark, "gate")
    write(spark.createDataFrame([tuple(values)], schema).coalesce(1), path, fmt)
    back = reader(spark, schema, fmt).load(path)
    same = [back.schema[f.name].dataType == f.dataType for f in schema.fields]
    # Text would also "restore" a type for which we know no telling value.
    return [t and b == v and (v is not None or fmt != "csv") for t, b, v in zip(same, back.first(), values)]


def _probe(spark: SparkSession, dtypes: list[T.DataType], fmt: str) -> list[bool]:
    try:
        return _round_trip(spark, dtypes, fmt)
    except Exception:
        # One refused type fails the whole row: try them one by one.
        return [False] if len(dtypes) == 1 else [_probe(spark, [d], fmt)[0] for d in dtypes]


def unrestorable_columns(schema: T.StructType, fmt: str) -> list[tuple[str, str]]:
    """(name, type) of every column a published table could not give back."""
    unknown = {f.dataType.json(): f.dataType for f in schema.fields if (f.dataType.json(), fmt) not in _VERDICTS}
    if unknown:
        verdicts = _probe(SparkSession.active(), list(unknown.values()), fmt)
        _VERDICTS.update({(key, fmt): verdict for key, verdict in zip(unknown, verdicts)})
    return [(f.name, f.dataType.simpleString()) for f in schema.fields if not _VERDICTS[f.dataType.json(), fmt]]
