"""Manifests and producers of a project as DataFrames."""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import messages as M
from ..functions.text import base_name, code_hash, parent
from ..plans import staged
from .storage import texts

# --- fixed values: record version and field names of a manifest -----------------
MANIFEST_VERSION = 1
SHARED_ENDING = ".manifest.json"
BUNDLE_MANIFEST = "manifest.json"
MANIFEST_DDL = """
    manifest_version int, kind string, id string, title string, notebook string, cell_code_sha256 string, created string,
    code_deps array<struct<module: string, path: string, sha256: string>>,
    inputs array<struct<kind: string, path: string, sha256: string, size: bigint, name: string>>,
    outputs array<struct<filename: string, sha256: string, size: bigint, content: string, files: bigint, version: string>>,
    bulk struct<version: string, sha256: string, content: string, files: bigint, size: bigint>,
    schema map<string, string>, schema_json string, format string, rows bigint
"""
LEDGER_DDL = "output string, path string, size bigint, sha256 string"
LEDGER_ENDING = ".ledger"
# ------------------------------------------------------------------------------------


def parse_manifests(documents: DataFrame) -> DataFrame:
    """``path, text`` -> ``path, folder, problem, m`` with the manifest as struct ``m``.

    A text that is no manifest, or one of a newer version, has a ``problem`` and
    a null ``m``. Nothing raises.
    """
    fields = T._parse_datatype_string(MANIFEST_DDL)
    with_corrupt = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("text", with_corrupt, {"columnNameOfCorruptRecord": "_corrupt"})
    version = F.coalesce(F.expr("try_cast(get_json_object(text, '$.manifest_version') as int)"), F.lit(1))
    rows = documents.withColumns({"_m": parsed, "_version": version, "folder": parent(F.col("path"))})
    is_object = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    newer = M.filled(M.MANIFEST_LATER, F.col("path"), F.col("_version"), F.lit(MANIFEST_VERSION))
    problem = (
        F.when(is_object & (F.col("_version") > MANIFEST_VERSION), newer)
        .when(~is_object | F.col("_m").isNull() | F.col("_m._corrupt").isNotNull(), M.MANIFEST_UNREADABLE)
    )
    rows = rows.withColumn("problem", problem)
    record = F.struct(*[F.col(f"_m.{name}").alias(name) for name in fields.names])
    return rows.select("path", "folder", "problem", F.when(F.col("problem").isNull(), record).alias("m"))


def manifest_documents(files: DataFrame, root: str, shared: str, preserved: str) -> DataFrame:
    """``path, text`` of every manifest among the project files."""
    path = F.col("path")
    in_shared = (parent(path) == shared) & path.endswith(SHARED_ENDING)
    in_preserved = path.startswith(preserved + "/") & (base_name(path) == BUNDLE_MANIFEST)
    return texts(files.filter(in_shared | in_preserved).select("path"), root)


@dataclass(frozen=True)
class Producer:
    """The code that produces an artifact: a named unit of a notebook file."""

    notebook: str
    name: str
    code: str

    @classmethod
    def of(cls, function: Callable, notebook: str) -> "Producer":
        """Producer for a top-level function of the file ``notebook`` (project-relative)."""
        return cls(notebook, function.__name__, textwrap.dedent(inspect.getsource(function)))

    @property
    def stem(self) -> str:
        return self.notebook.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def code_units(source: str | None) -> list[tuple[str, str]]:
    """(name, code) of every top-level function, decorators included, in file order."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    lines = (source or "").splitlines(keepends=True)
    units = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            start = min([node.lineno, *[d.lineno for d in node.decorator_list]])
            units.append((node.name, "".join(lines[start - 1 : node.end_lineno])))
    return units


def producers(notebooks: DataFrame, root: str) -> DataFrame:
    """``notebook, cell, code, code_sha256, position`` for notebook files (column ``path``)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, name, code, position)
                for path, text in zip(batch["path"], batch["text"])
                for position, (name, code) in enumerate(code_units(text))
            ]
            yield pd.DataFrame(rows, columns=["notebook", "cell", "code", "position"])

    units = texts(staged(notebooks.select("path").distinct()), root).mapInPandas(split, "notebook string, cell string, code string, position int")
    return units.withColumn("code_sha256", code_hash(F.col("code")))
