"""Code units, the modules they import, and classified inputs."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ancestors, code_hash, relative_to, stem
from ..plans import lookup

# --- fixed values: path parts that mark installed rather than project code, and
# the name every unnamed unit carries
VENDORED_PARTS = (".venv", "site-packages")
UNNAMED = "_"
# ---------------------------------------------------------------------------------


def imported_names(code: str | None) -> list[str]:
    """Dotted names a Python text imports absolutely; none when it does not parse.

    ``from a import b`` counts as both ``a`` and ``a.b``, since ``b`` may be a module.
    """
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return []
    names = set()
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=aliases):
                names |= {a.name for a in aliases}
            case ast.ImportFrom(module=str(origin), names=aliases, level=0):
                names |= {origin, *(f"{origin}.{a.name}" for a in aliases)}
    return sorted(names)


def unit_imports(units: DataFrame, key: Sequence[str], code: str = "code") -> DataFrame:
    """One row per (unit, imported name); the parse runs in Arrow batches."""
    keys = list(key)
    fields = [units.schema[k] for k in keys]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "module string"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            out["module"] = [imported_names(c) for c in batch[code]]
            yield out.explode("module").dropna(subset=["module"])

    return units.select(*keys, code).mapInPandas(parse, schema)


def with_ancestors(imports: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add every parent package of each imported name."""
    names = F.concat(F.array("module"), ancestors(F.col("module")))
    return imports.select(*key, F.explode(names).alias("module")).distinct()


def project_modules(modules: DataFrame, *, excluded: Sequence[str] = ("tabletrail",)) -> DataFrame:
    """Modules of the project itself: not installed packages, not the library."""
    parts = F.split("path", "/")
    vendored = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in VENDORED_PARTS]))
    top = F.substring_index("module", ".", 1)
    return modules.filter(~vendored & ~top.isin(list(excluded)) & ~F.col("path").startswith("/"))


def code_deps(units: DataFrame, key: Sequence[str], modules: DataFrame, code: str = "code") -> DataFrame:
    """(key, module, path, sha256) for each project module a unit imports.

    Names that resolve to no project module are dropped. Not transitive.
    """
    names = with_ancestors(unit_imports(units, key, code), key)
    return lookup(names, project_modules(modules), ["module"], "inner")


def with_code_hash(units: DataFrame, code: str = "code", name: str = "code_sha256") -> DataFrame:
    return units.withColumn(name, code_hash(F.col(code)))


def input_kind(path: Column, shared: str = "data/shared", external: str = "data/external") -> Column:
    """Kind of an input by where it lives (project-relative path)."""
    return (
        F.when(path.startswith(shared + "/"), "shared")
        .when(path.startswith(external + "/"), "external")
        .otherwise("file")
    )


def describe_inputs(declared: DataFrame, files: DataFrame, published: DataFrame, *, root: str = "") -> DataFrame:
    """Classify and fingerprint declared input paths.

    ``declared(path)``; ``files(path, size, sha256)`` on disk; ``published(path,
    sha256)`` versions recorded by shared manifests. A shared input is pinned to
    its published version. ``problem`` says why an input cannot be recorded.
    """
    rows = declared.withColumn("path", relative_to(F.col("path"), root)) if root else declared
    joined = lookup(rows, files, ["path"], rename={"size": "_size", "sha256": "_sha"})
    joined = lookup(joined, published, ["path"], rename={"sha256": "_version"})
    kind = input_kind(F.col("path"))
    is_shared = kind == "shared"
    found = F.col("_sha").isNotNull() | F.col("_version").isNotNull()
    return joined.withColumns(
        {
            "kind": kind,
            "name": F.when(is_shared, stem(F.col("path"))),
            "size": F.when(~is_shared, F.col("_size")),
            "sha256": F.when(is_shared, F.col("_version")).otherwise(F.col("_sha")),
            "problem": F.when(~found, "does not exist").when(is_shared & F.col("_version").isNull(), "no manifest records it"),
        }
    ).drop("_size", "_sha", "_version")
