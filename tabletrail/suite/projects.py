"""Whole project trees: publish given tables, damage or change some, and ask the tree what it knows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import base_name
from ..plans import new_scratch, staged
from ..project import SHARED, Project
from ..sinks import manifests
from ..sources.catalog import Producer
from ..sources.storage import hashed, parquet_columns, walk
from .audits import UNIT_CODE_DEPS_SQL, imported_units
from .publishing import UNIT
from .registry import Tables, query

NAMES = ("benchmark", "nation", "region")
_PUBLISHED_SQL = " UNION ALL ".join(f"SELECT '{name}' AS name, count(*)::BIGINT AS rows FROM {name}" for name in NAMES)


def _publish(t: Tables, names: tuple[str, ...] = NAMES) -> Project:
    project = Project(t.spark, new_scratch(t.spark, "tree"))
    for name in names:
        project.save_shared(getattr(t, name), name, inputs=[], producer=UNIT)
    return project


def _add_part(project: Project, name: str) -> None:
    """A copy of one part file beside the parts that were published."""
    table = project.shared_path(name)
    versions = [entry for entry, folder in project.storage.children(table) if folder and not entry.endswith(".ledger")]
    folder = f"{table}/{versions[0]}"
    part = min(entry for entry, _ in project.storage.children(folder) if entry.startswith("part-"))
    project.storage.copy(f"{folder}/{part}", f"{folder}/part-99999-added.parquet")


def _answers(t: Tables, rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


@query(f"SELECT name, CASE WHEN name <> 'region' THEN rows END AS rows FROM ({_PUBLISHED_SQL})")
def load_shared_tampered(t: Tables) -> DataFrame:
    """Rows of each table that verified reading returns; none of a table with an added part."""
    project = _publish(t)
    _add_part(project, "region")
    answers = []
    for name in NAMES:
        try:
            rows = project.load_shared(name).agg(F.count(F.lit(1)).alias("rows"))
        except Exception as error:
            if "not part of what was published" not in str(error):
                raise
            rows = getattr(t, name).agg(F.lit(None).cast("long").alias("rows"))
        answers.append(rows.select(F.lit(name).alias("name"), "rows"))
    return _answers(t, answers)


@query(
    f"""SELECT name, 'notebooks/suite.py' AS notebook, rows, 'data/shared/' || name || '.parquet' AS path,
        CASE name WHEN 'region' THEN 1 ELSE 0 END AS n_problems FROM ({_PUBLISHED_SQL})"""
)
def list_shared(t: Tables) -> DataFrame:
    project = _publish(t)
    _add_part(project, "region")
    return project.list_shared().select("name", "notebook", F.col("rows").cast("long").alias("rows"), "path", F.size("problems").alias("n_problems"))


def _files_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("text").alias("content"))


def _edited(name: str) -> Producer:
    """The producer of a bundle after its code changed."""
    return Producer(UNIT.notebook, name, f"def {name}():\n    return 1\n")


_FILE_SQL = "SELECT doc_id || '.txt' AS filename, strlen({0})::BIGINT AS size, sha256({0}) AS sha256 FROM documents"


@query(_FILE_SQL.format("CASE WHEN lang = 'de' THEN reverse(text) ELSE text END"))
def bundle_add(t: Tables) -> DataFrame:
    """All documents as files of one bundle, the German ones added again with other content."""
    project = Project(t.spark, new_scratch(t.spark, "tree"))
    project.preserve_files(_files_of(t.documents), "suite", producer=UNIT)
    edited = t.documents.filter("lang = 'de'").withColumn("text", F.reverse("text"))
    project.preserve_files(_files_of(edited), "suite", producer=UNIT)
    return _in_place(project, "data/preserved/suite/suite").join(project.bundle_files("suite", "suite"), ["filename", "size", "sha256"], "left_semi")


def _in_place(project: Project, folder: str) -> DataFrame:
    """Name, size and hash of the files that lie in a bundle's folder, but for its manifest."""
    files = staged(walk(project.spark, project.root, [folder]).filter(~F.col("path").endswith("/manifest.json")))
    return hashed(files, project.root).select(base_name(F.col("path")).alias("filename"), "size", "sha256")


@query(_FILE_SQL.format("text") + " WHERE lang = 'en' UNION ALL SELECT 'note.txt', 4, sha256('note')")
def bundle_replace(t: Tables) -> DataFrame:
    """A bundle of all documents whose code changed: only the English ones and a note, given since, remain."""
    project, changed = Project(t.spark, new_scratch(t.spark, "tree")), _edited("suite")
    project.preserve_files(_files_of(t.documents), "suite", producer=UNIT)
    project.preserve_files(_files_of(t.documents.filter("lang = 'en'")), "suite", producer=changed)
    project.preserve_file("note", "suite", filename="note.txt", producer=changed)
    return _in_place(project, "data/preserved/suite/suite").join(project.bundle_files("suite", "suite"), ["filename", "size", "sha256"], "left_semi")


@query(
    """SELECT 'in_' || lang AS id, 'notebooks/suite.py' AS notebook, 'data/preserved/suite/in_' || lang AS path, count(*)::BIGINT AS n_files,
        CASE lang WHEN 'de' THEN 2 ELSE 0 END AS n_problems FROM documents WHERE lang IS NOT NULL GROUP BY lang"""
)
def list_preserved(t: Tables) -> DataFrame:
    """A bundle of files for each language; in the German one, one file was lost and one changed."""
    project = Project(t.spark, new_scratch(t.spark, "tree"))
    for row in t.documents.select("lang").filter("lang is not null").distinct().collect():
        name = f"in_{row['lang']}"
        project.preserve_files(_files_of(t.documents.filter(F.col("lang") == row["lang"])), name, producer=Producer(UNIT.notebook, name, UNIT.code))
    names = [r["filename"] for r in project.bundle_files("suite", "in_de").orderBy("filename").limit(2).collect()]
    project.storage.delete(f"{project.root}/data/preserved/suite/in_de/{names[0]}")
    project.storage.write(f"{project.root}/data/preserved/suite/in_de/{names[1]}", b"other")
    listed = project.list_preserved("suite")
    return listed.select("id", "notebook", "path", F.col("n_files").cast("long").alias("n_files"), F.size("problems").alias("n_problems"))


@query(
    """SELECT 'supplier-' || l_suppkey AS name, count(*)::BIGINT AS rows, round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 4) AS tax, l_suppkey % 10 = 0 AS written,
        0::BIGINT AS errors FROM lineitem GROUP BY l_suppkey"""
)
def publish_many(t: Tables) -> DataFrame:
    """The items of each supplier as a table of their own, all at once; then again with other rows for every tenth."""
    project = Project(t.spark, new_scratch(t.spark, "tree"))
    items = t.lineitem.withColumn("name", F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")))
    tenth = F.col("l_suppkey") % 10 == 0
    project.save_shared_many(items.withColumn("l_tax", F.when(tenth, F.col("l_tax") + 1).otherwise(F.col("l_tax"))), "name", inputs=[], producer=UNIT)
    published = project.save_shared_many(items, "name", inputs=[], producer=UNIT)
    # The files are found and read by tasks: a pattern over so many folders would be opened on the driver, one by one.
    parts = staged(walk(t.spark, project.root, [SHARED]).filter(F.col("path").rlike(f"^{SHARED}/[^/]+\\.parquet/[^/]*[0-9a-f]/part-[^/]*$")))
    stem = F.regexp_extract("path", r"/([^/]+)\.parquet/", 1)
    rows = parquet_columns(parts, project.root, t.lineitem.select("l_quantity", "l_tax").schema).select("*", stem.alias("name"))
    read = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_tax"), 4).alias("tax"))
    wrong = project.check().problems.filter("severity = 'error'").groupBy(F.regexp_extract("artifact", "shared/([^/]+)", 1).alias("name")).agg(F.count(F.lit(1)).alias("e"))
    joined = published.join(read, "name").join(wrong, "name", "left").filter("n = rows")
    return joined.select("name", "rows", "quantity", "tax", "written", F.coalesce("e", F.lit(0)).cast("long").alias("errors"))


_CONSUMED = {"benchmark": ("item_id", "text"), "conversations": ("conv_id", "turn", "role", "text"), "documents": ("doc_id", "text", "lang", "source")}


def _identity_sql(name: str, columns: tuple[str, ...]) -> str:
    """SQL of a table's content identity: its row count, the lane sums of its row digests, and its types."""
    text = " || ',' || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '~')" for c in columns)
    lanes = " || '|' || ".join(f"coalesce(sum(('0x' || substr(d, {8 * i + 1}, 8))::BIGINT), 0)::VARCHAR" for i in range(4))
    types = ";".join(f"{c}:{'string' if c in ('text', 'role', 'lang', 'source') else 'bigint'}" for c in columns)
    return f"""SELECT 'data/shared/{name}.parquet' AS path, 'shared' AS kind, '{name}' AS name, sha256(count(*) || '|' || {lanes} || '|{types}') AS sha256
        FROM (SELECT sha256({text}) AS d FROM {name})"""


@query(" UNION ALL ".join(_identity_sql(*item) for item in _CONSUMED.items()))
def resolve_inputs(t: Tables) -> DataFrame:
    """Published tables as inputs of a consumer, pinned to their content."""
    project = Project(t.spark, new_scratch(t.spark, "tree"))
    for name, columns in _CONSUMED.items():
        project.save_shared(getattr(t, name).select(*columns), name, inputs=[], producer=UNIT)
    entries = project.resolve_inputs([project.shared_path(name) for name in _CONSUMED])
    return t.spark.createDataFrame([(e["path"], e["kind"], e["name"], e["sha256"]) for e in entries], "path string, kind string, name string, sha256 string")


@query(
    """SELECT path, kind, CASE WHEN lang = 'de' THEN NULL ELSE strlen(text)::BIGINT END AS size, CASE WHEN lang = 'de' THEN NULL ELSE sha256(text) END AS sha256,
        CASE WHEN lang = 'de' THEN 'does not exist' END AS problem
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'external' ELSE 'file' END AS kind,
      CASE WHEN doc_id % 2 = 0 THEN 'data/external/' || doc_id ELSE 'inputs/' || doc_id END AS path FROM documents)"""
)
def project_inputs(t: Tables) -> DataFrame:
    """Every document as a declared input file of a tree; the German ones are not there."""
    project = Project(t.spark, new_scratch(t.spark, "tree"))
    place = F.when(F.col("doc_id") % 2 == 0, F.lit("data/external/")).otherwise(F.lit("inputs/"))
    files = t.documents.select(F.concat(place, F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "lang")
    staged(manifests.write_documents(files.filter("lang is null or lang <> 'de'"), project.root))
    declared = files.select(F.concat(F.lit(project.root + "/"), "path").alias("path"))
    return project.describe_inputs(declared).select("path", "kind", "size", "sha256", "problem")


@query(UNIT_CODE_DEPS_SQL)
def project_code_deps(t: Tables) -> DataFrame:
    """The modules that units import, found and hashed as files of a tree."""
    project = Project(t.spark, new_scratch(t.spark, "tree"))
    units, modules = imported_units(t)
    staged(manifests.write_documents(modules.select("path", F.col("module").alias("content")), project.root))
    return project.code_deps_of(units, ["page_id"])


@query(
    """SELECT name, n::BIGINT AS errors FROM (SELECT 'benchmark-copy' AS name, 1 AS n FROM (SELECT count(*) AS c FROM benchmark) WHERE c > 0
    UNION ALL SELECT 'nation-copy', 0)"""
)
def shared_stale(t: Tables) -> DataFrame:
    """Consumers of two tables after one of these was published with other content."""
    project = _publish(t, ("benchmark", "nation"))
    for name in ("benchmark", "nation"):
        source = project.load_shared(name)
        project.save_shared(source, f"{name}-copy", inputs=[project.shared_path(name)], producer=UNIT)
    project.save_shared(t.benchmark.select("item_id", F.upper("text").alias("text")), "benchmark", inputs=[], producer=UNIT)
    listed = project.list_shared().filter(F.col("name").endswith("-copy"))
    return listed.select("name", F.size("problems").cast("long").alias("errors"))


@query(f"SELECT name, rows, true AS unchanged FROM ({_PUBLISHED_SQL})")
def republish_unchanged(t: Tables) -> DataFrame:
    """Publishing equal rows in another order leaves every manifest as it was."""
    project = _publish(t)
    ending = "data/shared/{}.manifest.json"
    before = {name: project.storage.read(f"{project.root}/{ending.format(name)}") for name in NAMES}
    for name in NAMES:
        project.save_shared(getattr(t, name).repartition(3), name, inputs=[], producer=UNIT)
    same = {name: project.storage.read(f"{project.root}/{ending.format(name)}") == before[name] for name in NAMES}
    return _answers(t, [project.load_shared(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(same[name]).alias("unchanged")) for name in NAMES])


@query(
    """SELECT 'benchmark' AS name, 'error' AS severity, 1::BIGINT AS n FROM (SELECT count(*) AS c FROM benchmark) WHERE c > 0
    UNION ALL SELECT unnest(['benchmark', 'nation', 'region']), 'warning', 1"""
)
def project_check(t: Tables) -> DataFrame:
    """The audit of a tree: an added part is an error; the notebook is absent, which is a warning for each table."""
    project = _publish(t)
    _add_part(project, "benchmark")
    problems = staged(project.check().problems)
    name = F.regexp_extract("artifact", "shared/([a-z]+)", 1)
    return problems.groupBy(name.alias("name"), "severity").agg(F.count(F.lit(1)).alias("n"))
