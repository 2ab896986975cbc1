"""Audit passes. Each takes DataFrames and returns ``artifact, severity, message``.

The inputs may be catalog files of a project or any tables of the same columns.
Hashes are compared, never recomputed here: each distinct path is hashed once
upstream and joined to every artifact that mentions it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages as M
from ..functions.text import parent
from ..plans import bounded_by, lookup, staged
from .lineage import UNNAMED

PROBLEM_COLUMNS = ("artifact", "severity", "message")


def _problems(df: DataFrame, severity: Column, message: Column) -> DataFrame:
    return df.select("artifact", severity.alias("severity"), message.alias("message")).filter("message is not null")


def verify_outputs(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Missing, then size, then content: the first that fails is reported.

    ``recorded(artifact, path, filename, size, sha256)``; ``current(path, size,
    sha256)``, where a hash is needed only for files of the recorded size.
    """
    joined = lookup(recorded, current, ["path"], rename={"size": "_size", "sha256": "_sha"}, flag="_found", unique=True)
    name = F.col("filename")
    message = (
        F.when(F.col("_found").isNull(), M.filled(M.OUTPUT_MISSING, name))
        .when(~F.col("size").eqNullSafe(F.col("_size")), M.filled(M.OUTPUT_SIZE, name))
        .when(~F.col("sha256").eqNullSafe(F.col("_sha")), M.filled(M.OUTPUT_CONTENT, name))
    )
    return _problems(joined, F.lit(M.ERROR), message)


def verify_inputs(inputs: DataFrame, files: DataFrame, published: DataFrame) -> DataFrame:
    """Missing or changed inputs, by kind.

    ``inputs(artifact, kind, path, sha256)``; ``files(path, sha256)`` on disk;
    ``published(path, sha256)`` the version each shared manifest records now.
    """
    joined = lookup(inputs, files, ["path"], rename={"sha256": "_sha"}, flag="_found")
    joined = lookup(joined, published, ["path"], rename={"sha256": "_version"})
    path, kind = F.col("path"), F.coalesce("kind", F.lit("file"))
    stale = ~F.col("sha256").eqNullSafe(F.col("_version"))
    changed = F.coalesce(F.col("sha256"), F.lit("")) != ""
    changed = changed & ~F.col("sha256").eqNullSafe(F.col("_sha"))
    message = (
        F.when(F.col("_found").isNull(), M.filled(M.INPUT_MISSING, path))
        .when((kind == "shared") & stale, M.filled(M.INPUT_OLD_VERSION, path))
        .when((kind == "external") & changed, M.filled(M.INPUT_EXTERNAL_CHANGED, path))
        .when((kind != "shared") & changed, M.filled(M.INPUT_CHANGED, path))
    )
    only_warns = (kind == "external") & F.col("_found").isNotNull()
    return _problems(joined, F.when(only_warns, M.WARNING).otherwise(M.ERROR), message)


def verify_code(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Missing or edited modules. ``deps(artifact, module, path, sha256)``."""
    joined = lookup(deps, files, ["path"], rename={"sha256": "_sha"}, flag="_found")
    message = F.when(F.col("_found").isNull(), M.filled(M.MODULE_MISSING, F.col("path"))).when(
        ~F.col("sha256").eqNullSafe(F.col("_sha")), M.filled(M.MODULE_CHANGED, F.col("module"))
    )
    return _problems(joined, F.lit(M.ERROR), message)


def identity_of_shared(manifests: DataFrame, producers: DataFrame) -> DataFrame:
    """Shared tables whose producing code is in no unit of their notebook.

    ``manifests(artifact, notebook, code_sha256)``; ``producers(notebook, cell, code_sha256)``.
    """
    producers = staged(producers)
    readable = bounded_by(producers.select("notebook").distinct(), producers)
    joined = lookup(manifests, readable, ["notebook"], flag="_readable")
    hashes = bounded_by(producers.select("notebook", "code_sha256").distinct(), producers)
    joined = lookup(joined, hashes, ["notebook", "code_sha256"], flag="_match")
    notebook = F.col("notebook")
    message = F.when(F.col("_readable").isNull(), M.filled(M.CELLS_UNREADABLE, notebook)).when(
        F.col("_match").isNull(), M.filled(M.NO_MATCHING_CELL, notebook)
    )
    return _problems(joined, F.lit(M.WARNING), message)


def identity_of_preserved(manifests: DataFrame, producers: DataFrame) -> DataFrame:
    """Bundles whose producing unit was renamed, deleted or edited.

    ``manifests(artifact, id, notebook, code_sha256)``. Unnamed units cannot own a
    bundle; of several units with one name the last by ``position`` counts.
    """
    producers = staged(producers)
    named = producers.filter(F.col("cell") != UNNAMED)
    current = named.groupBy("notebook", "cell").agg(F.max_by("code_sha256", "position").alias("_sha"))
    readable = bounded_by(producers.select("notebook").distinct(), producers)
    joined = lookup(manifests, readable, ["notebook"], flag="_readable")
    current = bounded_by(current.withColumnRenamed("cell", "id"), producers)
    joined = lookup(joined, current, ["notebook", "id"], flag="_named")
    name, notebook = F.col("id"), F.col("notebook")
    message = (
        F.when(F.col("_readable").isNull(), M.filled(M.CELLS_UNREADABLE, notebook))
        .when(F.col("_named").isNull(), M.filled(M.NO_SUCH_CELL, name, notebook))
        .when(~F.col("_sha").eqNullSafe(F.col("code_sha256")), M.filled(M.CELL_CHANGED, name))
    )
    severity = F.when(F.col("_readable").isNull(), M.WARNING).otherwise(M.ERROR)
    return _problems(joined, severity, message)


def unlisted_files(files: DataFrame, claimed: DataFrame, unreadable: DataFrame, *, shared: str = "data/shared") -> DataFrame:
    """Files no manifest claims. ``files(path)``, ``claimed(path)``, ``unreadable(folder)``.

    Placeholders, and all that lies at any depth below a folder whose manifest cannot be
    read, are left out.
    """
    rows = files.select("path").filter(~F.col("path").rlike(r"(^|/)\.gitkeep$"))
    rows = rows.join(claimed.select("path").distinct(), "path", "left_anti")
    marked = unreadable.select(F.col("folder").alias("_folder")).distinct()
    parts = F.split(parent(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda depth: F.array_join(F.slice(parts, 1, depth), "/"))
    known = lookup(rows.select("path", F.explode(above).alias("_folder")), marked, ["_folder"], flag="_skip")
    rows = known.groupBy("path").agg(F.max(F.col("_skip").isNotNull()).alias("_hidden")).filter(~F.col("_hidden"))
    writer = F.when(F.col("path").startswith(shared + "/"), M.SHARED_WRITER).otherwise(M.PRESERVED_WRITER)
    return rows.select(
        F.col("path").alias("artifact"), F.lit(M.ERROR).alias("severity"), M.filled(M.FILE_UNRECORDED, writer).alias("message")
    )


def all_problems(*passes: DataFrame) -> DataFrame:
    """Union of audit passes."""
    first, *rest = passes
    for other in rest:
        first = first.unionByName(other)
    return first.select(*PROBLEM_COLUMNS)


def problem_summary(problems: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: ``checked``, ``errors``, ``warnings``, ``ok``."""
    told = problems.select(*[(F.col("severity") == kind).cast("bigint").alias(name) for kind, name in ((M.ERROR, "errors"), (M.WARNING, "warnings"))], F.lit(0).cast("bigint").alias("checked"))
    seen = checked.select(F.lit(0).cast("bigint").alias("errors"), F.lit(0).cast("bigint").alias("warnings"), F.lit(1).cast("bigint").alias("checked"))
    total = told.unionByName(seen).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("checked", "errors", "warnings")])
    return total.withColumn("ok", F.col("errors") == 0)


def listing(artifacts: DataFrame, files: DataFrame, problems: DataFrame) -> DataFrame:
    """Per artifact: file and problem counts, with the first of each.

    All measures merge, so an artifact may own any number of files. Use the two
    input tables for the full lists.
    """
    per_file = files.groupBy("artifact").agg(F.count(F.lit(1)).alias("n_files"), F.min("filename").alias("first_file"))
    per_problem = problems.groupBy("artifact").agg(
        F.count_if(F.col("severity") == M.ERROR).alias("n_errors"),
        F.count_if(F.col("severity") == M.WARNING).alias("n_warnings"),
        F.min("message").alias("first_problem"),
    )
    listed = lookup(lookup(artifacts, per_file, ["artifact"]), per_problem, ["artifact"])
    return listed.fillna(0, ["n_files", "n_errors", "n_warnings"])
