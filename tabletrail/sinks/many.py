"""Publish many small tables in one job.

One shuffle brings the rows of each table together, split where a table is large. Each
task streams its rows into part files, hashing the bytes and the rows as it writes
them, so nothing is read again. A second, small shuffle brings the parts of each table
together, and its tasks write ledgers and manifests. A table is in the same form as one that
``save_shared`` publishes, and a manifest is again the last thing written, table by table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.fingerprint import LANES, identity, row_digest
from ..plans import lookup, staged
from ..sources.catalog import LEDGER_DDL, LEDGER_ENDING
from ..sources.storage import _arrow
from .manifests import document

ROWS_PER_FILE = 1_000_000
_PART = f"name string, path string, size bigint, sha256 string, rows bigint, {', '.join(f'lane{i} string' for i in range(LANES))}"
_DONE = "name string, path string, rows bigint, files bigint, size bigint, content string, version string, written boolean"


class _Hashing:
    """A sink that hashes and counts what passes to a stream."""

    def __init__(self, stream):
        self.stream, self.digest, self.size, self.closed = stream, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        data = bytes(data)
        self.digest.update(data)
        self.size += len(data)
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass

    def tell(self) -> int:
        return self.size

    def writable(self) -> bool:
        return True

    def readable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.stream.close()
        self.closed = True


def _lanes(digests: pa.Array) -> list[int]:
    """The lane sums of hex digests, see :func:`tabletrail.functions.fingerprint.lane_sums`."""
    words = np.frombuffer(bytes.fromhex("".join(digests.to_pylist())), ">u4").reshape(len(digests), -1)
    return [int(x) for x in words[:, :LANES].sum(axis=0, dtype=np.uint64)]


class _Part:
    """One part file being written."""

    def __init__(self, root: str, path: str, schema: pa.Schema):
        import pyarrow.parquet as pq

        filesystem, target = _arrow(f"{root}/{path}")
        filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
        self.path, self.rows, self.lanes = path, 0, [0] * LANES
        self.sink = _Hashing(filesystem.open_output_stream(target))
        self.writer = pq.ParquetWriter(self.sink, schema, compression="snappy")

    def add(self, rows: pa.RecordBatch, digests: pa.Array) -> None:
        self.writer.write_batch(rows)
        self.rows += len(rows)
        self.lanes = [a + b for a, b in zip(self.lanes, _lanes(digests))]

    def close(self) -> tuple:
        self.writer.close()
        self.sink.close()
        return self.path, self.sink.size, self.sink.digest.hexdigest(), self.rows, *map(str, self.lanes)


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple]:
    """Value and rows of each stretch of equal values."""
    values, start = batch.column(column).to_pylist(), 0
    for end in range(1, len(values) + 1):
        if end == len(values) or values[end] != values[start]:
            yield values[start], batch.slice(start, end - start)
            start = end


def write_parts(df: DataFrame, name: str, root: str, layer: str, version: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write the rows of each table below ``<layer>/<name>.parquet/<version>``; one row per part file, staged.

    ``name`` is the column that tells a row's table; it is not part of any.
    """
    own = [c for c in df.columns if c != name]
    table = df.select(*[F.col(f"`{c}`") for c in own])
    digest = row_digest(table.schema)
    counts = staged(df.groupBy(name).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_files", F.ceil(F.col("_rows") / rows_per_file)))
    dealt = lookup(df.withColumn("_digest", digest), counts, [name], rename={"_files": "_files"}, weight="_rows")
    # Dealt by content: a task that runs again sees the same rows.
    seat = F.pmod(F.xxhash64("_digest"), F.col("_files"))
    file = F.concat_ws("/", F.col(f"`{name}`"), F.lpad(seat.cast("string"), 5, "0")).alias("_file")
    placed = dealt.select(file, "_digest", *[F.col(f"`{c}`") for c in own]).repartition("_file").sortWithinPartitions("_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * LANES]
        labels = ["name", "path", "size", "sha256", "rows", *[f"lane{i}" for i in range(LANES)]]
        current, part, attempt = None, None, TaskContext.get().taskAttemptId()

        def closed() -> pa.RecordBatch:
            row = (current.rsplit("/", 1)[0], *part.close())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=labels)

        for batch in batches:
            for file, rows in _runs(batch, "_file"):
                data = rows.select(own)
                if file != current:
                    if part is not None:
                        yield closed()
                    table_name, seat = file.rsplit("/", 1)
                    # Named by attempt: what a lost attempt has written is no part of the table.
                    current, part = file, _Part(root, f"{layer}/{table_name}.parquet/{version}/part-{seat}-{attempt}.parquet", data.schema)
                part.add(data, rows.column("_digest"))
        if part is not None:
            yield closed()

    return staged(placed.mapInArrow(run, _PART))


def write_manifests(
    parts: DataFrame, root: str, layer: str, ending: str, version: str, table_schema, record: Callable[[str, dict | None, dict, int], dict],
) -> DataFrame:
    """Ledger and manifest of each table, written by tasks; one row per table, staged.

    ``record(name, previous, output, rows)`` builds a manifest. A table whose rows are
    those that its manifest already names, and whose part files are there, stays as it is.
    """
    size_and_hash = parts.select("size", "sha256").schema
    entry_digest = row_digest(size_and_hash)
    ordered = parts.withColumn("_entry", entry_digest).repartition("name").sortWithinPartitions("name", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        labels = [part.split()[0] for part in _DONE.split(", ")]
        table = None

        def finished() -> pa.RecordBatch:
            row = table.finish(record)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=labels)

        for batch in batches:
            for name, rows in _runs(batch, "name"):
                if table is None or table.name != name:
                    if table is not None:
                        yield finished()
                    table = _Table(name, root, layer, ending, version, table_schema, size_and_hash)
                table.add(rows)
        if table is not None:
            yield finished()

    return staged(ordered.mapInArrow(run, _DONE))


class _Table:
    """One table of which all parts are written: its ledger streams to a file, then its manifest."""

    def __init__(self, name: str, root: str, layer: str, ending: str, version: str, schema, entry_schema):
        import pyarrow.parquet as pq

        self.name, self.version, self.schema, self.entry_schema = name, version, schema, entry_schema
        self.folder = f"{layer}/{name}.parquet"
        self.filesystem, self.base = _arrow(f"{root}/{self.folder}")
        self.manifest = _arrow(f"{root}/{layer}/{name}{ending}")[1]
        self.path = f"{self.base}/{version}{LEDGER_ENDING}"
        self.attempt = TaskContext.get().taskAttemptId()
        self.filesystem.create_dir(self.path, recursive=True)
        self.ledger_name = f"part-{self.attempt}.parquet"
        self.stream = self.filesystem.open_output_stream(f"{self.path}/{self.ledger_name}")
        kinds = {"output": pa.string(), "path": pa.string(), "size": pa.int64(), "sha256": pa.string()}
        assert list(kinds) == [c.split()[0] for c in LEDGER_DDL.split(", ")]
        self.writer = pq.ParquetWriter(self.stream, pa.schema(list(kinds.items())))
        self.rows = self.files = self.size = 0
        self.lanes, self.entry_lanes, self.names = [0] * LANES, [0] * LANES, set()

    def add(self, parts: pa.RecordBatch) -> None:
        paths, sizes = parts.column("path"), parts.column("size")
        output = pa.array([self.folder] * len(parts))
        self.writer.write_batch(pa.RecordBatch.from_arrays([output, paths, sizes, parts.column("sha256")], schema=self.writer.schema))
        self.files += len(parts)
        self.size += sum(sizes.to_pylist())
        self.rows += sum(parts.column("rows").to_pylist())
        self.names |= {p.rsplit("/", 1)[-1] for p in paths.to_pylist()}
        for i in range(LANES):
            self.lanes[i] += sum(map(int, parts.column(f"lane{i}").to_pylist()))
        self.entry_lanes = [a + b for a, b in zip(self.entry_lanes, _lanes(parts.column("_entry")))]

    def finish(self, record: Callable) -> tuple:
        self.writer.close()
        self.stream.close()
        content = identity(self.rows, self.lanes, self.schema)
        output = {
            "filename": f"{self.name}.parquet", "sha256": identity(self.files, self.entry_lanes, self.entry_schema), "size": self.size,
            "content": content, "files": self.files, "version": self.version,
        }
        previous = self._previous()
        recorded = next((o for o in (previous or {}).get("outputs", []) if o["filename"] == output["filename"] and o.get("version")), None)
        own = bool(recorded) and recorded["version"] == self.version  # written by an earlier attempt
        unchanged = bool(recorded) and not own and recorded.get("content") == content and self._present(recorded)
        if unchanged:
            self._drop(self.version)
            output = recorded
        else:
            self._write(document(record(self.name, previous, output, self.rows)))
            self._tidy()
        return self.name, self.folder, self.rows, output["files"], output["size"], content, output["version"], not unchanged

    def _previous(self) -> dict | None:
        try:
            with self.filesystem.open_input_stream(self.manifest) as stream:
                return json.loads(stream.read())
        except (FileNotFoundError, ValueError):
            return None

    def _children(self, folder: str) -> list:
        from pyarrow.fs import FileSelector

        return self.filesystem.get_file_info(FileSelector(folder, allow_not_found=True))

    def _present(self, recorded: dict) -> bool:
        """Whether the recorded run has as many part files and bytes as its manifest says, and a ledger."""
        parts = [i for i in self._children(f"{self.base}/{recorded['version']}") if i.is_file and not i.base_name.startswith((".", "_"))]
        ledger = self._children(f"{self.base}/{recorded['version']}{LEDGER_ENDING}")
        return bool(ledger) and (len(parts), sum(i.size for i in parts)) == (recorded.get("files"), recorded.get("size"))

    def _drop(self, version: str) -> None:
        for folder in (version, version + LEDGER_ENDING):
            self.filesystem.delete_dir_contents(f"{self.base}/{folder}", missing_dir_ok=True)
            self.filesystem.delete_dir(f"{self.base}/{folder}")

    def _write(self, data: bytes) -> None:
        draft = f"{self.manifest}.{self.attempt}.tmp"
        with self.filesystem.open_output_stream(draft) as stream:
            stream.write(data)
        self.filesystem.move(draft, self.manifest)

    def _tidy(self) -> None:
        """Drop other runs, and in this one what lost attempts have left."""
        keep = {self.version: self.names, self.version + LEDGER_ENDING: {self.ledger_name}}
        for info in self._children(self.base):
            if info.base_name not in keep:
                (self.filesystem.delete_file if info.is_file else self.filesystem.delete_dir)(info.path)
        for folder, names in keep.items():
            for info in self._children(f"{self.base}/{folder}"):
                if info.base_name not in names:
                    self.filesystem.delete_file(info.path)
