"""Many files of one bundle, recorded in a ledger table.

    <bundle>/<filename>                      the files, as people see them
    <bundle>.ledger/<version>/part-*         one row per file: output, path, size, sha256
    <bundle>.drafts/<version>/<filename>     files on their way

The manifest holds the ledger's version and digest only, so neither it nor the driver
ever holds the list of files. Files are written as drafts, the ledger of all current files
is an anti join of the old one and the new rows, and only when the manifest names that ledger are
drafts moved into place and superseded files dropped, both by tasks. A failure before
the manifest leaves the bundle as it was; one after it is made good by the next call.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fingerprint import table_identity
from ..functions.text import base_name
from ..plans import staged
from ..sources import textformat
from ..sources.catalog import LEDGER_DDL, LEDGER_ENDING
from ..sources.storage import Storage, _arrow, _spread, hashed, walk
from .manifests import write_documents
from .tables import LEDGER_ROWS_PER_FILE, ledger_digest

DRAFTS = ".drafts"


@dataclass(frozen=True)
class Ledger:
    """The files of a bundle after a call, not yet in place. ``entry`` is null for none."""

    entry: dict | None
    rows: DataFrame | None
    moves: DataFrame | None = None


def ledger_path(root: str, bundle: str, recorded: dict) -> str:
    return f"{root}/{bundle}{LEDGER_ENDING}/{recorded['version']}"


def recorded_files(spark: SparkSession, root: str, bundle: str, recorded: dict | None) -> DataFrame:
    """``output, path, size, sha256`` of the files that a manifest's ``bulk`` record stands for."""
    if recorded is None:
        return spark.createDataFrame([], LEDGER_DDL)
    return spark.read.schema(LEDGER_DDL).parquet(ledger_path(root, bundle, recorded))


def add(files: DataFrame, root: str, bundle: str, recorded: dict | None, carried: bool) -> Ledger:
    """Write ``filename, content`` rows as drafts and a ledger of all files there will be.

    ``recorded`` is the bundle's previous record; its files stay where ``carried``, unless
    a new one has their name. A file that is in place with the same content keeps its place.
    """
    spark, version = files.sparkSession, uuid.uuid4().hex[:12]
    drafts = F.concat(F.lit(f"{bundle}{DRAFTS}/{version}/"), "filename").alias("path")
    written = staged(write_documents(files.select(drafts, "content"), root, new=True))
    place = F.concat(F.lit(f"{bundle}/"), base_name(F.col("path")))
    new = written.select(F.lit(bundle).alias("output"), place.alias("path"), "size", "sha256")
    old = recorded_files(spark, root, bundle, recorded)
    rows = (old.join(new, "path", "left_anti") if carried else old.limit(0)).unionByName(new)
    # Only files said to be the same already are read again.
    same = staged(new.join(old, ["path", "size", "sha256"], "left_semi").select("path", "size", "sha256"))
    in_place = hashed(same.withColumnRenamed("sha256", "_sha256"), root).filter("sha256 = _sha256").select("path")
    moves = staged(new.join(in_place, "path", "left_anti").select("path"))
    ledger = _written(rows, root, bundle, version, recorded)
    return Ledger(ledger.entry, ledger.rows, moves.select(F.concat(F.lit(f"{bundle}{DRAFTS}/{version}/"), base_name(F.col("path"))).alias("draft"), "path"))


def without(names: list[str], root: str, bundle: str, recorded: dict, spark: SparkSession) -> Ledger:
    """The recorded files but for some ``names`` that are now files of their own."""
    old = recorded_files(spark, root, bundle, recorded)
    named = base_name(F.col("path")).isin(names)
    if old.filter(named).isEmpty():
        return Ledger(recorded, old)
    return _written(old.filter(~named), root, bundle, uuid.uuid4().hex[:12], recorded)


def _written(rows: DataFrame, root: str, bundle: str, version: str, recorded: dict | None) -> Ledger:
    spark, path = rows.sparkSession, f"{root}/{bundle}{LEDGER_ENDING}/{version}"
    rows = staged(rows)
    content = table_identity(rows.select("path", "size", "sha256"))
    if recorded is not None and recorded.get("content") == content:
        return Ledger(recorded, rows)
    totals = rows.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")).first()
    if not totals["files"]:
        return Ledger(None, None)
    textformat.write(rows.repartition(-(-totals["files"] // LEDGER_ROWS_PER_FILE)), path, "parquet")
    ledger = spark.read.schema(LEDGER_DDL).parquet(path)
    entry = {"version": version, "sha256": ledger_digest(ledger), "content": content, "files": totals["files"], "size": totals["size"]}
    return Ledger(entry, ledger)


def settle(storage: Storage, root: str, bundle: str, ledger: Ledger, spark: SparkSession, keep: list[str], replaced: bool) -> None:
    """After the manifest: move drafts into place, then drop what the bundle no longer has.

    ``keep`` are the names of its other files and tables. Where the bundle was
    ``replaced``, everything that neither they nor the ledger name goes.
    """
    if ledger.moves is not None:
        _moved(ledger.moves, root)
    if replaced:
        first = F.regexp_extract(F.substring(F.col("path"), len(bundle) + 2, 1 << 20), "^[^/]+", 0)
        gone = walk(spark, root, [bundle]).filter(~first.isin(keep))
        _deleted(gone.join(ledger.rows, "path", "left_anti") if ledger.rows is not None else gone, root)
        for name, folder in storage.children(f"{root}/{bundle}") if ledger.rows is None else ():
            if folder and name not in keep:
                storage.delete(f"{root}/{bundle}/{name}")
    storage.delete(f"{root}/{bundle}{DRAFTS}")
    current = ledger.entry["version"] if ledger.entry else None
    for version, _ in storage.children(f"{root}/{bundle}{LEDGER_ENDING}"):
        if version != current:
            storage.delete(f"{root}/{bundle}{LEDGER_ENDING}/{version}")
    if current is None:
        storage.delete(f"{root}/{bundle}{LEDGER_ENDING}")


def resume(storage: Storage, root: str, bundle: str, recorded: dict | None, spark: SparkSession) -> None:
    """Finish the moves of a call that ended after its manifest."""
    if recorded is None or not storage.exists(f"{root}/{bundle}{DRAFTS}/{recorded['version']}"):
        return
    drafts = walk(spark, root, [f"{bundle}{DRAFTS}/{recorded['version']}"])
    _moved(staged(drafts.select(F.col("path").alias("draft"), F.concat(F.lit(f"{bundle}/"), base_name(F.col("path"))).alias("path"))), root)


def _moved(moves: DataFrame, root: str) -> None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for batch in batches:
            for draft, path in zip(batch["draft"], batch["path"]):
                filesystem, source = _arrow(f"{root}/{draft}")
                target = _arrow(f"{root}/{path}")[1]
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                try:
                    filesystem.move(source, target)
                except FileNotFoundError:
                    pass  # moved by an earlier attempt of this task
            yield pd.DataFrame({"n": [len(batch)]})

    _spread(moves).mapInPandas(run, "n int").agg(F.sum("n")).collect()


def _deleted(paths: DataFrame, root: str) -> None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                filesystem, target = _arrow(f"{root}/{path}")
                try:
                    filesystem.delete_file(target)
                except FileNotFoundError:
                    pass  # deleted by an earlier attempt of this task
            yield pd.DataFrame({"n": [len(batch)]})

    _spread(staged(paths.select("path"))).mapInPandas(run, "n int").agg(F.sum("n")).collect()
