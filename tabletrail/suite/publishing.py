"""Publishing and reading back whole tables, and scans of project files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import numbers, text
from ..operators.plots import PlotSource
from ..operators.summaries import group_moments
from ..plans import new_scratch, staged
from ..project import Project
from ..sinks import manifests
from ..sources import chunks, textformat
from ..sources.catalog import Producer, parse_manifests, producers
from ..sources.external import read_files
from ..sources.storage import hashed, walk
from .registry import Tables, query

UNIT = Producer("notebooks/suite.py", "suite", "def suite():\n    pass\n")


def _project(spark: SparkSession) -> Project:
    return Project(spark, new_scratch(spark, "project"))


@query("SELECT * FROM orders")
def publish_roundtrip(t: Tables) -> DataFrame:
    project = _project(t.spark)
    project.save_shared(t.orders, "orders", inputs=[], producer=UNIT, sort_by=["o_orderkey"])
    return project.load_shared("orders")


@query("SELECT doc_id, n_chars, text, lang, CASE WHEN lang <> 'en' THEN source END AS source, CASE WHEN lang = 'de' THEN '' ELSE lang END AS blank FROM documents")
def publish_text_roundtrip(t: Tables) -> DataFrame:
    project = _project(t.spark)
    documents = t.documents.select(
        "doc_id", "n_chars", "text", "lang", F.when(F.col("lang") != "en", F.col("source")).alias("source"),
        F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("blank"),
    )
    project.save_shared(documents, "documents", inputs=[], producer=UNIT, fmt="csv")
    return project.load_shared("documents")


@query("SELECT * FROM part")
def preserve_roundtrip(t: Tables) -> DataFrame:
    project = _project(t.spark)
    project.preserve_table(t.part, "suite", producer=UNIT, filename="parts")
    path = project.preserved_path("suite.py", "suite", "parts.csv")
    return textformat.reader(t.spark, t.part.schema, "csv").load(path)


@query(
    """WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b,
        quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem GROUP BY 1),
    w AS (SELECT l.l_returnflag, l_extendedprice AS v, n, a, b, c, l_extendedprice BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) AS inside
        FROM lineitem l JOIN q ON q.l_returnflag = l.l_returnflag)
    SELECT l_returnflag, n::BIGINT AS n, round(b, 6) AS median, count(*) FILTER (WHERE NOT inside)::BIGINT AS n_outliers, count(*)::BIGINT AS n_source,
        round(sum(v), 2) AS total, ['boxes-marks.csv', 'boxes-source.csv'] AS files FROM w GROUP BY l_returnflag, n, a, b, c"""
)
def plot_source(t: Tables) -> DataFrame:
    """The rows and the boxes of a figure, preserved together and read back."""
    project = _project(t.spark)
    spec = PlotSource("box", "l_returnflag", "l_extendedprice")
    project.preserve_plot(spec, t.lineitem, "suite", producer=UNIT, filename="boxes")
    source, marks = (textformat.reader(t.spark, schema, "csv").load(project.preserved_path("suite", "suite", f"boxes-{name}.csv"))
                     for name, schema in (("source", "l_returnflag string, l_extendedprice double"), ("marks", _MARKS)))
    totals = source.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_source"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    listed = project.list_preserved("suite").first()["files"]
    files = F.array(*[F.lit(name) for name in sorted(listed)])
    return marks.join(totals, "l_returnflag").select("l_returnflag", "n", F.round("median", 6).alias("median"), "n_outliers", "n_source", "total", files.alias("files"))


_MARKS = "l_returnflag string, n bigint, q1 double, median double, q3 double, whisker_low double, whisker_high double, n_outliers bigint"


@query("SELECT * REPLACE (o_orderkey::INT AS o_orderkey, o_custkey::INT AS o_custkey, o_orderdate::DATE AS o_orderdate) FROM orders")
def external_csv(t: Tables) -> DataFrame:
    project = _project(t.spark)
    path = project.external_path("orders.csv")
    exported = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    exported.write.option("header", "true").csv(path)
    return project.load_external("orders.csv")


@query("SELECT * FROM customer")
def external_tsv(t: Tables) -> DataFrame:
    project = _project(t.spark)
    customers = t.customer
    customers.write.option("header", "true").option("sep", "\t").csv(project.external_path("customer.tsv"))
    return project.load_external("customer.tsv", schema=customers.schema)


@query("SELECT doc_id || '.txt' AS name, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def external_binary(t: Tables) -> DataFrame:
    """External files of no known table format, by their path and any reader."""
    project = _project(t.spark)
    path = F.concat(F.lit("data/external/texts/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    staged(manifests.write_documents(t.documents.select(path.alias("path"), F.col("text").alias("content")), project.root))
    files = read_files(t.spark, project.external_path("texts"))
    return files.select(text.base_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


@query(
    """SELECT unnest(['conv_id', 'role', 'text', 'turn']) AS name, unnest(['bigint', 'string', 'string', 'bigint']) AS type, true AS restorable,
        unnest([0::BIGINT, count(*) FILTER (WHERE role = '\\N'), count(*) FILTER (WHERE text = '\\N'), 0::BIGINT]) AS reserved FROM conversations"""
)
def gate_report(t: Tables) -> DataFrame:
    table = t.conversations
    lost = dict(textformat.unrestorable_columns(table.schema, "csv"))
    counts = []
    for field in table.schema.fields:
        is_text = isinstance(field.dataType, T.StringType)
        reserved = F.count_if(F.col(field.name) == textformat.NULL_TEXT) if is_text else F.lit(0).cast("bigint")
        counts.append(F.struct(
            F.lit(field.name).alias("name"), F.lit(field.dataType.simpleString()).alias("type"),
            F.lit(field.name not in lost).alias("restorable"), reserved.alias("reserved"),
        ))
    return table.agg(F.explode(F.array(*counts)).alias("r")).select("r.*")


@query(
    """SELECT l_suppkey, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1"""
)
def cached_summary(t: Tables) -> DataFrame:
    project = _project(t.spark)
    columns = ["l_suppkey", "n", F.round("mean", 6).alias("mean")]

    def compute() -> DataFrame:
        return group_moments(t.lineitem, "l_suppkey", "l_quantity").select(*columns)

    def forbidden() -> DataFrame:
        raise AssertionError("a cached stage was computed again")

    project.cached_stage("summary", compute, code="v1")
    return project.cached_stage("summary", forbidden, code="v1\n")


def _document_files(t: Tables) -> DataFrame:
    path = F.concat(F.lit("data/preserved/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.documents.select(path.alias("path"), F.col("text").alias("content"))


_FILES_SQL = """SELECT 'data/preserved/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents"""


@query(f"SELECT *, true AS written FROM ({_FILES_SQL})")
def write_files(t: Tables) -> DataFrame:
    return staged(manifests.write_documents(_document_files(t), new_scratch(t.spark, "files")))


@query(_FILES_SQL)
def walk_files(t: Tables) -> DataFrame:
    root = new_scratch(t.spark, "files")
    staged(manifests.write_documents(_document_files(t), root))
    return hashed(staged(walk(t.spark, root, ["data/preserved"])), root)


# Bytes from 512 k on of every text, and the tree over them with 256 digests a node.
_CHUNKS_SQL = """SELECT doc_id, k AS chunk, 512 * k AS start, least(512, size - 512 * k) AS length, sha256(coalesce(body[512 * k + 1:512 * k + 512], ''::BLOB)) AS sha256
    FROM (SELECT doc_id, encode(text) AS body, strlen(text)::BIGINT AS size, unnest(range(0, greatest((strlen(text) + 511) // 512, 1))) AS k FROM documents)"""


def _document_chunks(t: Tables, root: str) -> DataFrame:
    """The chunks of all documents, written as files."""
    written = staged(manifests.write_documents(_document_files(t), root))
    return chunks.chunk_digests(written.select("path", "size"), root, 512)


@query(
    f"""WITH c AS ({_CHUNKS_SQL}), t AS (SELECT doc_id, count(*) AS n, CASE WHEN count(*) = 1 THEN any_value(sha256) ELSE sha256(string_agg(sha256, '' ORDER BY chunk)) END AS root FROM c GROUP BY doc_id)
    SELECT doc_id, chunk, start, length, sha256, root FROM c JOIN t USING (doc_id)"""
)
def chunk_digests(t: Tables) -> DataFrame:
    """Every chunk of every document file with its digest and the file's root."""
    found = _document_chunks(t, new_scratch(t.spark, "files"))
    top = chunks.roots(chunks.chunk_tree(found))
    digits = F.regexp_extract("path", r"/([^/]+)\.txt$", 1).cast("bigint")
    return found.join(top, "path").select(digits.alias("doc_id"), "chunk", "start", "length", "sha256", "root")


@query(
    """SELECT doc_id, CASE WHEN gone THEN 0 ELSE 512 * ((size - 1) // 512) END AS start, CASE WHEN gone THEN size ELSE size - 512 * ((size - 1) // 512) END AS length
    FROM (SELECT doc_id, strlen(text)::BIGINT AS size, lang = 'es' AS gone FROM documents WHERE lang IN ('de', 'es') AND strlen(text) > 0)"""
)
def chunk_damage(t: Tables) -> DataFrame:
    """Document files of which the Spanish are lost and the last byte of the German ones was changed: the ranges to restore."""
    root = new_scratch(t.spark, "files")
    before = _document_chunks(t, root)
    files = _document_files(t).join(t.documents.select("lang", F.col("doc_id").cast("string").alias("_id")), F.regexp_extract("path", r"/([^/]+)\.txt$", 1) == F.col("_id"))
    other = F.concat(F.expr("substring(cast(content AS binary), 1, octet_length(content) - 1)"), F.lit(b"\x00"))
    changed = files.filter("lang <> 'es' and content <> ''").select("path", F.when(F.col("lang") == "de", other).otherwise(F.col("content").cast("binary")).alias("content"))
    second = new_scratch(t.spark, "files")
    now = chunks.chunk_digests(staged(manifests.write_documents(changed, second)).select("path", "size"), second, 512)
    recorded = before.filter("length > 0")
    found = chunks.damaged_ranges(recorded, chunks.chunk_tree(recorded), now, chunks.chunk_tree(now))
    return found.select(F.regexp_extract("path", r"/([^/]+)\.txt$", 1).cast("bigint").alias("doc_id"), "start", "length")


_MANIFEST_SQL = """SELECT 'data/preserved/' || source || '/' || doc_id || '/manifest.json' AS path, * FROM documents"""


@query(
    f"""SELECT path, 'data/preserved/' || source || '/' || doc_id AS folder,
        CASE lang WHEN 'de' THEN path || ' has manifest_version 2; this version reads up to 1' WHEN 'en' THEN NULL ELSE 'unreadable manifest' END AS problem,
        CASE WHEN lang = 'en' THEN source END AS id, CASE WHEN lang = 'en' THEN sha256(text) END AS sha256, CASE WHEN lang = 'en' THEN n_chars END AS size
    FROM ({_MANIFEST_SQL})"""
)
def manifest_scan(t: Tables) -> DataFrame:
    output = F.struct(F.col("source").alias("filename"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("n_chars").alias("size"))
    record = manifests.record_json(
        F.col("source").alias("id"), F.when(F.col("lang") == "de", 2).otherwise(1).alias("manifest_version"), F.array(output).alias("outputs")
    )
    path = F.concat(F.lit("data/preserved/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/manifest.json"))
    content = F.when(F.col("lang").isin("en", "de"), record).otherwise(F.col("text"))
    parsed = parse_manifests(t.documents.select(path.alias("path"), content.alias("text")))
    first = F.element_at("m.outputs", 1)
    return parsed.select("path", "folder", "problem", "m.id", first["sha256"].alias("sha256"), first["size"].alias("size"))


@query(
    """SELECT 'notebooks/' || page_id || '.py' AS notebook, cell, code, sha256(regexp_replace(code, '^\\s+|\\s+$', '', 'g')) AS code_sha256, position::INT AS position
    FROM (SELECT page_id, unnest(['page_' || page_id, '_']) AS cell,
        unnest(['@app.cell' || chr(10) || 'def page_' || page_id || '():' || chr(10) || '    return "' || url || '"' || chr(10),
                'def _():' || chr(10) || '    return ' || page_id || chr(10)]) AS code, unnest([0, 1]) AS position FROM pages)"""
)
def producer_scan(t: Tables) -> DataFrame:
    root = new_scratch(t.spark, "notebooks")
    digits = F.col("page_id").cast("string")
    named = F.concat(F.lit("@app.cell\ndef page_"), digits, F.lit('():\n    return "'), "url", F.lit('"\n'))
    unnamed = F.concat(F.lit("def _():\n    return "), digits, F.lit("\n"))
    path = F.concat(F.lit("notebooks/"), digits, F.lit(".py"))
    source = F.concat(F.lit("import app\n\n"), named, F.lit("\n\n"), unnamed)
    written = staged(manifests.write_documents(t.pages.select(path.alias("path"), source.alias("content")), root))
    return producers(written, root)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F:2' ELSE 'F:2,' || o_orderstatus || ':1' END AS entries FROM orders"""
)
def record_replacement(t: Tables) -> DataFrame:
    def entry(name, size):
        return F.struct(name.alias("filename"), F.lit(size).alias("size"))

    records = F.array(entry(F.col("o_orderstatus"), 1))
    merged = numbers.replace_record(records, "filename", entry(F.lit("F"), 2))
    shown = F.transform(merged, lambda r: F.concat(r["filename"], F.lit(":"), r["size"].cast("string")))
    return t.orders.select("o_orderkey", text.joined(shown, ",").alias("entries"))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at, strftime(ts, '%H:%M:%S.%f') AS time, event_id BETWEEN -2147483647 AND 2147483647 AS fits,
        value::VARCHAR AS shown FROM events"""
)
def text_forms(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", text.datetime_text(F.col("ts")).alias("at"), text.time_text(F.col("ts")).alias("time"),
        numbers.fits_int32(F.col("event_id")).alias("fits"), F.col("value").cast("string").alias("shown"),
    )
