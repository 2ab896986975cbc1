"""Cut a plan at a measured intermediate table.

A staged table is computed once, lies in the shared scratch folder, and so
survives the loss of any executor. Its rows and bytes are measured on the way,
which is what later decides whether it may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T


def scratch_path(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a temporary one only in local mode."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured and not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    folder = configured or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach before "
            "running operators that stage intermediate tables"
        )
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tabletrail-"))
    return context.getCheckpointDir().rstrip("/")


_made: set[str] = set()


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the scratch folder."""
    path = f"{scratch_path(spark)}/{label}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Delete every scratch path this process made. No result built on them is usable afterwards."""
    conf = spark._jsc.hadoopConfiguration()
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def _row_bytes(schema: T.StructType) -> Column:
    """Approximate bytes of a row in memory."""
    total = F.lit(8 * len(schema.fields)).cast("bigint")
    for field in schema.fields:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            total = total + F.coalesce(F.octet_length(F.to_json(column)), F.lit(0))
    return total


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    Parquet rather than a checkpoint: the scan gives Catalyst a true size for its
    own join choices, and later readers prune columns. A staged table is passed
    through.
    """
    if getattr(df, "_is_staged", False):
        return df
    spark = df.sparkSession
    path = new_scratch(spark, "stage")
    # Measured in the result stage of the write, so once per partition.
    seen = Observation()
    measures = F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_bytes(df.schema)), F.lit(0)).alias("bytes")
    df.observe(seen, *measures).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._is_staged, table._rows, table._bytes = True, seen.get["rows"], seen.get["bytes"]
    return table


def bounded_by(df: DataFrame, table: DataFrame) -> DataFrame:
    """Mark ``df``, a projection of some rows of a staged ``table``, as no larger than it."""
    df._rows_limit, df._bytes_limit = table._rows, table._bytes
    return df


def bounded(df: DataFrame, rows: int, row_bytes: int = 1 << 10) -> DataFrame:
    """Mark ``df`` as at most ``rows`` rows, known from what it is made of."""
    df._rows_limit, df._bytes_limit = rows, rows * row_bytes
    return df


def row_count(df: DataFrame) -> int:
    """Rows of ``df``; known without a job for a staged table."""
    known = getattr(df, "_rows", None)
    return df.count() if known is None else known


def literal_rows(spark: SparkSession, column: str, values: list[str]) -> DataFrame:
    """A one-column table of a few given strings, planned without a Python source."""
    if not values:
        return spark.range(0).select(F.lit("").alias(column))
    return spark.range(1).coalesce(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))
