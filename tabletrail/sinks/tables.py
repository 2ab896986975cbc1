"""Write a table as one immutable run of part files plus a ledger of them.

    <table>/<run>/part-*          the rows
    <table>/<run>.ledger/part-*   one row per part file: path, size, sha256

Nothing is moved or overwritten: a run becomes current when a manifest names it.
The ledger is itself a table, so a manifest stays small however many part files
there are.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators.audit import verify_outputs
from ..plans import row_count, staged
from ..functions.fingerprint import LANES, identity, lane_sums, row_digest, table_identity
from ..sources import textformat
from ..sources.catalog import LEDGER_DDL, LEDGER_ENDING
from ..sources.errors import ArtifactError
from ..sources.storage import Storage, hashed, walk

LEDGER_ROWS_PER_FILE = 500_000


@dataclass(frozen=True)
class Run:
    """A written but not yet committed table."""

    table: str
    version: str
    rows: int
    content: str
    files: int
    size: int
    digest: str

    def output(self, filename: str) -> dict:
        return {
            "filename": filename, "sha256": self.digest, "size": self.size,
            "content": self.content, "files": self.files, "version": self.version,
        }


def write_run(df: DataFrame, root: str, table: str, fmt: str, *, sort_by: Sequence[str] = (), max_records_per_file: int = 0) -> Run:
    """One pass over ``df``: write the parts while summing rows and content lanes."""
    spark, storage = df.sparkSession, Storage(df.sparkSession)
    version = uuid.uuid4().hex[:12]
    target = f"{root}/{table}/{version}"
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    try:
        rows, content = _write_observed(df, target, fmt, max_records_per_file)
        ledger = _write_ledger(spark, root, table, version)
        totals = ledger.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")).first()
        return Run(table, version, rows, content, totals["files"], totals["size"] or 0, ledger_digest(ledger))
    except Exception:
        discard(storage, root, table, version)
        raise


def _write_observed(df: DataFrame, target: str, fmt: str, max_records: int) -> tuple[int, str]:
    # The metrics sit directly below the write, in its result stage, where each
    # partition is counted once even when tasks are retried.
    seen = Observation()
    text_columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    reserved = F.lit(0)
    if fmt == "csv":
        for name in text_columns:
            is_reserved = F.col("`" + name.replace("`", "``") + "`") == textformat.NULL_TEXT
            reserved = reserved + F.when(is_reserved, 1).otherwise(0)
    observed = df.withColumn("_digest", row_digest(df.schema)).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(reserved), F.lit(0)).alias("reserved"), *lane_sums(F.col("_digest"))
    )
    textformat.write(observed.drop("_digest"), target, fmt, max_records_per_file=max_records)
    metrics = seen.get
    if metrics["reserved"]:
        raise ArtifactError(
            f"{metrics['reserved']} text value(s) equal {textformat.NULL_TEXT!r}, which the text format reserves for null; "
            "replace them or publish as parquet"
        )
    if fmt == "parquet":
        # Row counts come from the file footers. Should they ever disagree with the
        # metrics, what is on disk decides.
        written = df.sparkSession.read.schema(df.schema).parquet(target)
        if written.count() != metrics["rows"]:
            return written.count(), table_identity(written)
    lanes = [metrics[f"lane{i}"] for i in range(LANES)]
    return metrics["rows"], identity(metrics["rows"], lanes, df.schema)


def _write_ledger(spark: SparkSession, root: str, table: str, version: str) -> DataFrame:
    parts = staged(walk(spark, root, [f"{table}/{version}"]))
    files = max(1, -(-row_count(parts) // LEDGER_ROWS_PER_FILE))
    entries = hashed(parts, root).select(F.lit(table).alias("output"), "path", "size", "sha256")
    path = f"{root}/{table}/{version}{LEDGER_ENDING}"
    textformat.write(entries.repartition(files), path, "parquet")
    return spark.read.schema(LEDGER_DDL).parquet(path)


def ledger_digest(ledger: DataFrame) -> str:
    """Identity of the part contents; part names differ between equal runs."""
    return table_identity(ledger.select("size", "sha256"))


def discard(storage: Storage, root: str, table: str, version: str) -> None:
    storage.delete(f"{root}/{table}/{version}")
    storage.delete(f"{root}/{table}/{version}{LEDGER_ENDING}")


def intact(spark: SparkSession, root: str, table: str, recorded: dict) -> bool:
    """Whether the recorded run is on disk with unchanged sizes and hashes."""
    return first_problem(spark, root, table, recorded) is None


def first_problem(spark: SparkSession, root: str, table: str, recorded: dict) -> str | None:
    """Text of the first failed check of a recorded run: added parts first, then sizes, then hashes."""
    version, name = recorded.get("version"), recorded["filename"]
    path = f"{root}/{table}/{version}{LEDGER_ENDING}"
    if not version or not Storage(spark).exists(path):
        return f"{name}: missing"
    ledger = spark.read.schema(LEDGER_DDL).parquet(path)
    if ledger_digest(ledger) != recorded.get("sha256"):
        return f"{name}: content changed since it was written"
    on_disk = walk(spark, root, [f"{table}/{version}"])
    added = on_disk.join(ledger.select("path"), "path", "left_anti").agg(F.min("path")).first()[0]
    if added:
        return f"{name}/{posixpath.basename(added)}: not part of what was published"
    part = F.concat(F.lit(name + "/"), F.substring_index("path", "/", -1))
    entries = ledger.select(F.lit(table).alias("artifact"), "path", part.alias("filename"), "size", "sha256")
    same_size = staged(on_disk.join(ledger.select("path", "size"), ["path", "size"], "left_semi"))
    current = on_disk.join(hashed(same_size, root).select("path", "sha256"), "path", "left")
    return verify_outputs(entries, current).agg(F.min("message")).first()[0]


def commit(storage: Storage, root: str, run: Run, recorded: dict | None, ok: bool) -> dict:
    """The output entry to record. Equal content on disk stays as it is.

    When the recorded run has the same content but damaged files, the new run
    takes its place under the recorded name, so the manifest does not change.
    """
    filename = run.table.rsplit("/", 1)[-1]
    if recorded and recorded.get("content") == run.content:
        if ok:
            discard(storage, root, run.table, run.version)
            return recorded
        version = recorded.get("version")
        if version:
            discard(storage, root, run.table, version)
            storage.rename(f"{root}/{run.table}/{run.version}", f"{root}/{run.table}/{version}")
            storage.delete(f"{root}/{run.table}/{run.version}{LEDGER_ENDING}")
            return {**run.output(filename), "version": version, "_relocated": True}
    return run.output(filename)


def rewrite_ledger(spark: SparkSession, root: str, table: str, version: str) -> None:
    Storage(spark).delete(f"{root}/{table}/{version}{LEDGER_ENDING}")
    _write_ledger(spark, root, table, version)


def drop_other_versions(storage: Storage, root: str, table: str, version: str) -> None:
    keep = {version, version + LEDGER_ENDING}
    for name, _ in storage.children(f"{root}/{table}"):
        if name not in keep:
            storage.delete(f"{root}/{table}/{name}")
