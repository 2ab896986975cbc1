"""Manifest records: building, merging and writing them."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages as M
from ..functions.text import code_hash
from ..sources.catalog import MANIFEST_VERSION, Producer
from ..sources.errors import ArtifactError
from ..sources.storage import Storage, _arrow

DRAFTS = ".drafts"  # folders of single tasks, gone when these end


def load(storage: Storage, path: str) -> dict | None:
    """The record at ``path`` as the audit would read it, but one of a later format is refused.

    None where there is no record to go by, so that a producer writes a new one.
    """
    text = storage.read(path).decode("utf-8", errors="replace") if storage.is_file(path) else ""
    try:
        record = json.loads(text)
    except ValueError:
        record = None
    version = record.get("manifest_version", 1) if isinstance(record, dict) else None
    if version is not None and version > MANIFEST_VERSION:
        raise ArtifactError(M.MANIFEST_LATER.format(path, version, MANIFEST_VERSION))
    return None if version is None else record


def document(manifest: dict) -> bytes:
    """Sorted keys and a final newline, so equal records are equal bytes."""
    return (json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode("utf-8")


def record(kind: str, name: str, title: str | None, producer: Producer, previous: dict | None, **fields) -> dict:
    """A complete record. Only the creation time survives from the previous one."""
    return {
        "manifest_version": MANIFEST_VERSION, "kind": kind, "id": name, "title": title, "notebook": producer.notebook,
        "cell_code_sha256": unit_hash(producer.code), "created": _first_time(previous), **fields,
    }


def _first_time(previous: dict | None) -> str:
    """When the artifact was first recorded: now, unless an earlier record says so."""
    if previous and previous.get("created"):
        return previous["created"]
    return dt.datetime.now(dt.UTC).replace(microsecond=0).isoformat()


def unit_hash(code: str) -> str:
    """Hash of one code unit; agrees with :func:`tabletrail.functions.text.code_hash`."""
    import hashlib

    return hashlib.sha256(code.strip().encode("utf-8")).hexdigest()


def merged(entries: list[dict], new: list[dict], key: str) -> list[dict]:
    """Entries with those of the same key replaced, sorted by it."""
    by_key = {e[key]: e for e in [*entries, *new]}
    return [by_key[k] for k in sorted(by_key)]


# --- many records at once -------------------------------------------------------------


def record_json(*sorted_fields: Column) -> Column:
    """One JSON record per row; pass the fields in key order."""
    return F.to_json(F.struct(*sorted_fields), {"ignoreNullFields": "false"})


def merged_records(entries: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Last record per key, for catalog-sized tables of inputs or outputs."""
    from ..operators.summaries import last_wins

    return last_wins(entries, keys, sequence)


def write_documents(documents: DataFrame, root: str, *, new: bool = False) -> DataFrame:
    """Write ``content`` (string or binary) to ``root/path`` for each row, in tasks.

    Returns ``path, size, sha256, written``; an unchanged file is not rewritten, and none is
    looked for where the caller knows by ``new`` that there are none. A file is
    written in a folder of its task, below ``root``, and then moved: tasks that create files
    in one folder wait for each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        # Named by attempt, as a speculative twin may write the same file.
        drafts = f"{root}/{DRAFTS}-{uuid.uuid4().hex[:12]}-{TaskContext.get().taskAttemptId()}"
        made = set()
        try:
            for batch in batches:
                rows = []
                for path, content in zip(batch["path"], batch["content"]):
                    data = content.encode("utf-8") if isinstance(content, str) else bytes(content)
                    filesystem, target = _arrow(f"{root}/{path}")
                    same = False
                    if not new:
                        try:
                            with filesystem.open_input_stream(target) as stream:
                                same = stream.read() == data
                        except (FileNotFoundError, OSError):
                            pass
                    if not same:
                        draft = f"{_arrow(drafts)[1]}/draft"
                        for folder in {target.rsplit("/", 1)[0], draft.rsplit("/", 1)[0]} - made:
                            filesystem.create_dir(folder, recursive=True)
                            made.add(folder)
                        with filesystem.open_output_stream(draft) as stream:
                            stream.write(data)
                        filesystem.move(draft, target)
                    rows.append((path, len(data), hashlib.sha256(data).hexdigest(), not same))
                yield pd.DataFrame(rows, columns=["path", "size", "sha256", "written"])
        finally:
            if made:
                filesystem, folder = _arrow(drafts)
                filesystem.delete_dir(folder)

    return documents.select("path", "content").mapInPandas(run, "path string, size bigint, sha256 string, written boolean")


__all__ = ["code_hash", "document", "load", "merged", "merged_records", "record", "record_json", "unit_hash", "write_documents"]
