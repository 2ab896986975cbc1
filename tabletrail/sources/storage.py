"""Files of a project: small ones from the driver, many or large ones in tasks.

The driver touches single small documents (manifests, notebooks) through the
Hadoop file system of the session. Listing trees, hashing and reading many files
runs in tasks over Arrow file systems, in fixed-size chunks, so no file has to
fit in memory.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import stat
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans import literal_rows, row_count, staged

CHUNK, FIRST_CHUNK = 1 << 20, 1 << 14
WALK_BOUND = 20_000  # entries that one task lists before it hands folders on
READ_BYTES, READ_FILES = 4 << 20, 1000  # in one batch of whole files


class Storage:
    """Driver-side operations on single files."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def is_file(self, path: str) -> bool:
        return self.exists(path) and self._fs(path).getFileStatus(self._path(path)).isFile()

    def children(self, path: str) -> list[tuple[str, bool]]:
        """(name, is_directory) of one folder."""
        if not self.exists(path):
            return []
        return [(s.getPath().getName(), s.isDirectory()) for s in self._fs(path).listStatus(self._path(path))]

    def read(self, path: str) -> bytes:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> bool:
        """Replace a small file in one step; False when it already holds ``data``."""
        if self.is_file(path) and self.read(path) == data:
            return False
        draft = self._draft(path)
        fs = self._fs(path)
        # A local file system keeps checksums beside its files; the raw one below it does not.
        if self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.ChecksumFileSystem").isInstance(fs):
            fs = fs.getRawFileSystem()
        fs.mkdirs(self._path(path).getParent())
        stream = fs.create(self._path(draft), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self.replace(draft, path)
        return True

    def copy(self, source: str, target: str) -> None:
        """Stream one file into place."""
        draft = self._draft(target)
        util = self._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(self._fs(source), self._path(source), self._fs(target), self._path(draft), False, True, self._conf)
        self.replace(draft, target)

    @staticmethod
    def _draft(path: str) -> str:
        """A name no other publisher uses, in the same folder."""
        return f"{path}.{uuid.uuid4().hex[:12]}.tmp"

    def replace(self, source: str, target: str) -> None:
        fs_package = self._jvm.org.apache.hadoop.fs
        option = getattr(fs_package, "Options$Rename")
        options = self._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        self._fs(target).mkdirs(self._path(target).getParent())
        context = fs_package.FileContext.getFileContext(self._fs(target).getUri(), self._conf)
        context.rename(self._qualified(source), self._qualified(target), options)

    def rename(self, source: str, target: str) -> None:
        self._fs(target).mkdirs(self._path(target).getParent())
        if not self._fs(source).rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def _qualified(self, path: str):
        return self._fs(path).makeQualified(self._path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


# --- in tasks ------------------------------------------------------------------


def _arrow(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _entries(uri: str, recursive: bool) -> Iterator[tuple[str, bool, int]]:
    """(relative path, is_file, size) below a folder, hidden names included.

    Checksum sidecars that a local Hadoop file system keeps beside a file are not
    files of the project. A local folder is listed name by name, whatever it holds;
    other file systems hand over a listing as a whole.
    """
    from pyarrow.fs import FileSelector, FileType, LocalFileSystem

    filesystem, base = _arrow(uri)
    if isinstance(filesystem, LocalFileSystem):
        yield from _local_entries(base, recursive)
        return
    found = filesystem.get_file_info(FileSelector(base, allow_not_found=True, recursive=recursive))
    present = {info.path for info in found} if any(info.path.endswith(".crc") for info in found) else set()
    for info in found:
        if _main_file(info.path) in present:
            continue
        yield info.path[len(base):].strip("/"), info.type == FileType.File, info.size or 0


def _local_entries(base: str, recursive: bool) -> Iterator[tuple[str, bool, int]]:
    left = [base]
    while left:
        folder = left.pop()
        if not os.path.exists(folder):
            continue
        with os.scandir(folder) as entries:
            for entry in entries:
                try:
                    info = entry.stat()
                except FileNotFoundError:  # gone, or a link to nothing
                    continue
                main = _main_file(entry.path)
                if main and os.path.exists(main):
                    continue
                is_file = stat.S_ISREG(info.st_mode)
                yield entry.path[len(base):].strip("/"), is_file, info.st_size if is_file else 0
                if recursive and stat.S_ISDIR(info.st_mode):
                    left.append(entry.path)


def _main_file(path: str) -> str | None:
    """The file whose checksums a sidecar of this path holds."""
    folder, name = posixpath.split(path)
    return posixpath.join(folder, name[1:-4]) if name.startswith(".") and name.endswith(".crc") else None


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Spread few rows that each mean much work over all cores, by their path if nothing else is said.

    The row count of ``df`` must be cheap. Without an explicit number adaptive
    execution would merge these small rows into one task.
    """
    most = df.sparkSession.sparkContext.defaultParallelism * 3
    return df.repartition(max(1, min(row_count(df), most)), *(by or ("path",)))


def walk(spark: SparkSession, root: str, folders: list[str], *, bound: int = WALK_BOUND) -> DataFrame:
    """``path, size`` of every file below ``root/<folder>``, paths relative to ``root``.

    A task lists folder by folder, deeper ones too, until it has seen ``bound`` entries; the
    folders it has not opened by then are dealt over all tasks of the next round. So a
    small tree takes one round however deep it is, and no task lists much more than
    ``bound`` entries or one folder.
    """
    schema = "path string, is_file boolean, size bigint"

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, seen = list(batch["path"])[::-1], 0
            while left and seen < bound:
                folder = left.pop()
                for entries in _chunks(_entries(f"{root}/{folder}", False), bound):
                    seen += len(entries)
                    left += [f"{folder}/{p}" for p, is_file, _ in entries if not is_file]
                    yield pd.DataFrame([(f"{folder}/{p}", True, size) for p, is_file, size in entries if is_file], columns=["path", "is_file", "size"])
            yield pd.DataFrame([(folder, False, 0) for folder in left], columns=["path", "is_file", "size"])

    unopened, found = literal_rows(spark, "path", folders), []
    while True:
        level = staged(_spread(unopened).mapInPandas(expand, schema))
        found.append(level.filter("is_file").select("path", "size"))
        unopened = level.filter("not is_file").select("path")
        unopened._rows = unopened.count()
        if not unopened._rows:
            break
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return files


def _chunks(entries: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while some := list(islice(entries, size)):
        yield some


def hashed(files: DataFrame, root: str) -> DataFrame:
    """Add ``sha256`` of the bytes at ``root/path``; null when unreadable.

    ``files`` is counted to size the job, so pass a staged or listed table.
    """
    columns = files.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["sha256"] = [_hash_one(f"{root}/{p}") for p in batch["path"]]
            yield batch[[*columns, "sha256"]]

    return _spread(files).mapInPandas(run, schema)


def _hash_one(uri: str) -> str | None:
    filesystem, path = _arrow(uri)
    digest, size = hashlib.sha256(), FIRST_CHUNK
    try:
        with filesystem.open_input_stream(path) as stream:
            while chunk := stream.read(size):
                digest.update(chunk)
                # Room for a whole chunk costs more than reading a small file.
                size = CHUNK if len(chunk) == size else size
    except (FileNotFoundError, OSError):
        return None
    return digest.hexdigest()


def contents(files: DataFrame, root: str) -> DataFrame:
    """``path, length, content`` of the bytes at ``root/path`` for each row of ``path, size``; a file that is gone fails the job.

    Files are opened by the tasks that read them; the driver neither lists nor plans them. A batch
    holds about ``READ_BYTES``, or one file that is larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _arrow(root)
        paths, data, held = [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(paths, pa.string()), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "length", "content"])

        for some in batches:
            for path, size in zip(some.column("path").to_pylist(), some.column("size").to_pylist()):
                if data and (held + size > READ_BYTES or len(data) >= READ_FILES):
                    yield batch()
                    paths, data, held = [], [], 0
                with filesystem.open_input_stream(f"{base}/{path}") as stream:
                    data.append(stream.read())
                paths.append(path)
                held += len(data[-1])
        if data:
            yield batch()

    return _spread(files).select("path", "size").mapInArrow(run, "path string, length bigint, content binary")


def texts(files: DataFrame, root: str) -> DataFrame:
    """Add ``text``, the decoded content; null when unreadable. For small documents."""
    columns = files.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", text string"

    def read(uri: str) -> str | None:
        filesystem, path = _arrow(uri)
        try:
            with filesystem.open_input_stream(path) as stream:
                return stream.read().decode("utf-8", errors="replace")
        except (FileNotFoundError, OSError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [read(f"{root}/{p}") for p in batch["path"]]
            yield batch[[*columns, "text"]]

    return _spread(files).mapInPandas(run, schema)


def parquet_rows(files: DataFrame, root: str, schema: str) -> DataFrame:
    """The rows of many small Parquet files at ``root/path``, read by tasks, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch["path"]:
                if path.rsplit("/", 1)[-1].startswith(("_", ".")):
                    continue
                filesystem, source = _arrow(f"{root}/{path}")
                try:
                    with filesystem.open_input_file(source) as stream:
                        for rows in pq.ParquetFile(stream).iter_batches():
                            yield rows.to_pandas()
                except (OSError, ValueError):
                    continue  # an unreadable ledger is an absent one

    return _spread(files).mapInPandas(run, schema)


def parquet_columns(files: DataFrame, root: str, schema: T.StructType) -> DataFrame:
    """``path`` and the columns of ``schema`` of every row of many small Parquet files at ``root/path``.

    Files are opened by the tasks that read them; the driver neither lists nor plans them.
    A file that cannot be read fails the job.
    """
    names = schema.fieldNames()
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesystem, source = _arrow(f"{root}/{path}")
                with filesystem.open_input_file(source) as stream:
                    for rows in pq.ParquetFile(stream).iter_batches(columns=names):
                        values = [rows.column(f.name).cast(f.type) for f in kinds]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *values], names=["path", *names])

    return _spread(files).select("path").mapInArrow(run, T.StructType([T.StructField("path", T.StringType()), *schema.fields]))


def identify(paths: DataFrame, root: str) -> DataFrame:
    """``path, size, sha256`` of each existing path; a folder is identified by its files.

    A path may be absolute or relative to ``root``. Missing paths give no row.
    """
    from ..functions.fingerprint import LANES, lane_sums, row_digest

    schema = "path string, part string, whole boolean, size bigint, location string"

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        for batch in batches:
            # A table costs more than a file, so many paths share one.
            rows = []
            for path in batch["path"]:
                uri = path if path.startswith("/") or "://" in path else f"{root}/{path}"
                filesystem, base = _arrow(uri)
                info = filesystem.get_file_info(base)
                if info.type == FileType.File:
                    rows.append((path, "", True, info.size, uri))
                elif info.type == FileType.Directory:
                    found = [(path, p, False, size, f"{uri}/{p}") for p, is_file, size in _entries(uri, True) if is_file]
                    # A folder without files still exists.
                    rows += found or [(path, None, False, 0, None)]
                if len(rows) >= WALK_BOUND:
                    yield pd.DataFrame(rows, columns=["path", "part", "whole", "size", "location"])
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "part", "whole", "size", "location"])

    parts = staged(_spread(staged(paths.select("path").distinct())).mapInPandas(expand, schema))
    named = parts.withColumnsRenamed({"path": "input", "location": "path"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["sha256"] = [_hash_one(p) if p else None for p in batch["path"]]
            yield batch[["input", "part", "whole", "size", "sha256"]]

    named._rows = row_count(parts)
    digests = _spread(named).mapInPandas(run, "input string, part string, whole boolean, size bigint, sha256 string")
    row = row_digest(digests.select("part", "size", "sha256").schema)
    grouped = digests.withColumn("_digest", row).groupBy("input").agg(
        F.sum("size").alias("size"),
        F.bool_and("whole").alias("_whole"),
        F.max("sha256").alias("_one"),
        F.count("part").alias("_parts"),
        *lane_sums(F.col("_digest")),
    )
    lanes = [F.col(f"lane{i}").cast("string") for i in range(LANES)]
    folder = F.sha2(F.concat_ws("|", F.col("_parts").cast("string"), *lanes), 256)
    return grouped.select(F.col("input").alias("path"), "size", F.when(F.col("_whole"), F.col("_one")).otherwise(folder).alias("sha256"))
