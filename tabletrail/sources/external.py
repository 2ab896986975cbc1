"""Reading tables the project does not own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans import staged
from .errors import ArtifactError
from .storage import Storage, contents, walk

# --- fixed values: delimiter by suffix of delimited text, and formats with their own schema ---
DELIMITERS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}
SELF_DESCRIBING = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json"}
HIDDEN = r"(^|/)([.]|_[^=/]*(/|$))"
# ------------------------------------------------------------------------------------------------


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, content`` of every file below a folder, of whatever format; hidden names are left out, as by Spark's readers.

    Spark's ``binaryFile`` keeps a record of each file on the driver; here tasks list and open them.
    """
    folder = folder.rstrip("/")
    if not Storage(spark).exists(folder):
        raise ArtifactError(f"no folder to read files from: {folder}")
    root, name = folder.rsplit("/", 1)
    files = walk(spark, root, [name])
    files = staged(files.filter(~F.substring("path", len(name) + 2, (1 << 31) - 1).rlike(HIDDEN)))
    return contents(files, root).withColumn("path", F.concat(F.lit(f"{root}/"), "path"))


def read_external(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a file or folder by its suffix. Give ``schema`` to skip inferring text types.

    Large delimited files are read in splits. Where quoted fields hold line breaks, pass
    ``multi_line``; each file is then one task.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    source = spark.read.schema(schema) if schema is not None else spark.read
    if suffix in DELIMITERS:
        options = {"header": "true", "sep": DELIMITERS[suffix], "escape": '"', "multiLine": str(multi_line).lower()}
        if schema is None:
            options |= {"inferSchema": "true", "preferDate": "true"}
        return source.options(**options).csv(path)
    if suffix in SELF_DESCRIBING:
        return source.format(SELF_DESCRIBING[suffix]).load(path)
    known = ", ".join([*DELIMITERS, *SELF_DESCRIBING])
    raise ArtifactError(f"no reader for suffix {suffix!r} (known: {known}); take external_path() and read it with any Spark source")
