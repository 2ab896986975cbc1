"""Audit passes over trees derived from the given tables.

Documents play files. Their recorded state comes from the labels: a labelled
document has a manifest entry, a toxic one has since been deleted, and one of low
quality was recorded with other content. The recorded size is the character
count, so a text with multi-byte characters has changed size. Conversations play
code units, and pages play modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from ..functions.fingerprint import fingerprint
from ..operators import audit, lineage
from ..plans import staged
from .registry import Tables, query

_FILES_SQL = """SELECT 'data/preserved/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, 'preserved/' || source || '-' || lang AS artifact,
    doc_id || '.txt' AS filename, strlen(text)::BIGINT AS size, sha256(text) AS sha256, sha256(reverse(text)) AS older, n_chars, quality, toxic,
    lang, source, doc_id FROM documents LEFT JOIN labels USING (doc_id)"""


def _files(t: Tables) -> DataFrame:
    """The tree these queries audit, staged as :meth:`Project.check` does, so that texts are hashed once."""
    digits, body = F.col("doc_id").cast("string"), F.col("text")
    return t.once("files", lambda: staged(t.documents.join(t.labels, "doc_id", "left").select(
        F.concat(F.lit("data/preserved/"), "source", F.lit("/"), "lang", F.lit("/"), digits, F.lit(".txt")).alias("path"),
        F.concat(F.lit("preserved/"), "source", F.lit("-"), "lang").alias("artifact"),
        F.concat(digits, F.lit(".txt")).alias("filename"),
        F.octet_length(body).cast("bigint").alias("size"),
        text.sha256(body.cast("binary")).alias("sha256"),
        text.sha256(F.reverse(body).cast("binary")).alias("older"),
        "n_chars", "quality", "toxic", "lang", "source", "doc_id",
    )))


def _on_disk(files: DataFrame) -> DataFrame:
    return files.filter(F.coalesce("toxic", F.lit(0)) == 0)


def _recorded(files: DataFrame) -> DataFrame:
    content = F.when(F.col("quality") == 1, F.col("sha256")).otherwise(F.col("older"))
    return files.filter("quality is not null").select("artifact", "path", "filename", F.col("n_chars").alias("size"), content.alias("sha256"))


_OUTPUTS_SQL = f"""SELECT artifact, 'error' AS severity, CASE WHEN toxic = 1 THEN filename || ': missing'
        WHEN n_chars <> size THEN filename || ': size changed since it was written'
        ELSE filename || ': content changed since it was written' END AS message
    FROM ({_FILES_SQL}) WHERE quality IS NOT NULL AND (toxic = 1 OR n_chars <> size OR (quality <> 1 AND sha256 <> older))"""


@query(_OUTPUTS_SQL)
def audit_outputs(t: Tables) -> DataFrame:
    files = _files(t)
    return audit.verify_outputs(_recorded(files), _on_disk(files).select("path", "size", "sha256"))


_UNLISTED_SQL = f"""SELECT path AS artifact, 'error' AS severity, 'no manifest records this file; preserve_*() did not write it' AS message
    FROM ({_FILES_SQL}) WHERE quality IS NULL AND lang <> 'es'"""


@query(_UNLISTED_SQL)
def audit_unlisted(t: Tables) -> DataFrame:
    files = _files(t)
    # The manifests of the Spanish bundles cannot be read.
    unreadable = files.filter("lang = 'es'").select(text.parent(F.col("path")).alias("folder"))
    claimed = _recorded(files).select("path")
    return audit.unlisted_files(_on_disk(files).select("path"), claimed, unreadable)


# Every English document was built from the one published table of its source.
_INPUTS_SQL = f"""SELECT artifact, quality, toxic, kind, CASE kind WHEN 'shared' THEN 'data/shared/' || source || '.csv'
      WHEN 'external' THEN 'data/external/' || doc_id ELSE 'inputs/' || doc_id END AS path,
      quality = 0 AS is_older, sha256, older, doc_id
    FROM (SELECT *, CASE lang WHEN 'en' THEN 'shared' WHEN 'de' THEN 'external' ELSE 'file' END AS kind FROM ({_FILES_SQL}))"""

_INPUT_PROBLEMS_SQL = f"""SELECT artifact, CASE WHEN kind = 'external' AND toxic IS DISTINCT FROM 1 THEN 'warning' ELSE 'error' END AS severity,
    CASE WHEN kind <> 'shared' AND toxic = 1 THEN 'input missing: ' || path
      WHEN kind = 'shared' THEN 'built from an older version of ' || path || '; re-run this cell'
      WHEN kind = 'external' THEN 'external input changed: ' || path ELSE 'input changed: ' || path END AS message
    FROM ({_INPUTS_SQL}) WHERE CASE WHEN kind = 'shared' THEN is_older ELSE toxic = 1 OR (is_older AND sha256 <> older) END"""


@query(_INPUT_PROBLEMS_SQL)
def audit_inputs(t: Tables) -> DataFrame:
    files = _files(t)
    published = t.documents.groupBy("source").agg(text.sha256(F.min("text").cast("binary")).alias("version"))
    published = published.select(F.concat(F.lit("data/shared/"), "source", F.lit(".csv")).alias("path"), F.col("version").alias("sha256"), "source")
    kind = F.when(F.col("lang") == "en", "shared").when(F.col("lang") == "de", "external").otherwise("file")
    digits = F.col("doc_id").cast("string")
    path = (
        F.when(kind == "shared", F.concat(F.lit("data/shared/"), "source", F.lit(".csv")))
        .when(kind == "external", F.concat(F.lit("data/external/"), digits))
        .otherwise(F.concat(F.lit("inputs/"), digits))
    )
    located = files.select("artifact", kind.alias("kind"), path.alias("path"), "sha256", "older", "quality", "toxic", "source")
    versions = published.select("source", F.col("sha256").alias("version"))
    now = F.when(F.col("kind") == "shared", F.col("version")).otherwise(F.col("sha256"))
    pinned = F.when(F.col("quality") == 0, F.col("older")).otherwise(now)
    inputs = located.join(versions, "source").select("artifact", "kind", "path", pinned.alias("sha256"))
    own = _on_disk(located.filter("kind <> 'shared'")).select("path", "sha256")
    return audit.verify_inputs(inputs, own.unionByName(published.select("path", "sha256")), published.select("path", "sha256"))


_MODULE_PROBLEMS_SQL = f"""SELECT artifact, 'error' AS severity, CASE WHEN toxic = 1 THEN 'module missing: ' || path
      ELSE source || '.m' || doc_id || ' changed since this was written; re-run the cell' END AS message
    FROM ({_FILES_SQL}) WHERE quality IS NOT NULL AND (toxic = 1 OR (quality <> 1 AND sha256 <> older))"""


@query(_MODULE_PROBLEMS_SQL)
def audit_code_deps(t: Tables) -> DataFrame:
    files = _files(t)
    module = F.concat("source", F.lit(".m"), F.col("doc_id").cast("string"))
    content = F.when(F.col("quality") == 1, F.col("sha256")).otherwise(F.col("older"))
    deps = files.filter("quality is not null").select("artifact", module.alias("module"), "path", content.alias("sha256"))
    return audit.verify_code(deps, _on_disk(files).select("path", "sha256"))


# Conversations with a system turn are notebooks that no longer exist. First turns
# are unnamed cells. Long user turns were edited, long assistant turns renamed.
_UNITS_SQL = """SELECT 'notebooks/' || conv_id || '.py' AS notebook, conv_id, turn, role, length(text) AS n, 'cell_' || turn AS id,
      conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AS gone, upper(text) <> text AS has_case FROM conversations"""


def _units(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, producers) of the conversation fixture."""
    notebook = F.concat(F.lit("notebooks/"), F.col("conv_id").cast("string"), F.lit(".py"))
    name = F.concat(F.lit("cell_"), F.col("turn").cast("string"))
    body, long = F.col("text"), F.length("text") > 300
    gone = t.conversations.filter("role = 'system'").select("conv_id").distinct()
    cell = F.when(F.col("turn") == 0, lineage.UNNAMED).when((F.col("role") == "assistant") & long, F.concat(F.lit("new_"), name)).otherwise(name)
    producers = t.conversations.join(gone, "conv_id", "left_anti").select(
        notebook.alias("notebook"), cell.alias("cell"), text.code_hash(body).alias("code_sha256"), F.col("turn").alias("position")
    )
    before = F.when((F.col("role") == "user") & long, F.upper(body)).otherwise(F.concat(body, F.lit("\n")))
    manifests = t.conversations.select(
        F.concat(F.lit("shared/"), F.col("conv_id").cast("string"), F.lit("-"), name).alias("artifact"),
        name.alias("id"), notebook.alias("notebook"), text.code_hash(before).alias("code_sha256"),
    )
    return manifests, producers


_SHARED_IDENTITY_SQL = f"""SELECT 'shared/' || conv_id || '-' || id AS artifact, 'warning' AS severity, CASE WHEN gone THEN 'cannot read cells of ' || notebook
      ELSE 'no cell in ' || notebook || ' matches the code that produced this table; the producer was edited or removed' END AS message
    FROM ({_UNITS_SQL}) WHERE gone OR (role = 'user' AND n > 300)"""


@query(_SHARED_IDENTITY_SQL)
def audit_identity_shared(t: Tables) -> DataFrame:
    return audit.identity_of_shared(*_units(t))


_PRESERVED_IDENTITY_SQL = f"""SELECT 'shared/' || conv_id || '-' || id AS artifact, CASE WHEN gone THEN 'warning' ELSE 'error' END AS severity,
    CASE WHEN gone THEN 'cannot read cells of ' || notebook
      WHEN turn = 0 OR (role = 'assistant' AND n > 300) THEN 'no cell named ''' || id || ''' in ' || notebook || '; the cell was renamed or deleted, orphaning this bundle'
      ELSE 'cell ''' || id || ''' changed since this was written; re-run it to update the artifact' END AS message
    FROM ({_UNITS_SQL}) WHERE gone OR turn = 0 OR (role IN ('user', 'assistant') AND n > 300)"""


@query(_PRESERVED_IDENTITY_SQL)
def audit_identity_preserved(t: Tables) -> DataFrame:
    return audit.identity_of_preserved(*_units(t))


_ALL_SQL = " UNION ALL ".join(
    [_OUTPUTS_SQL, _UNLISTED_SQL, _INPUT_PROBLEMS_SQL, _MODULE_PROBLEMS_SQL, _SHARED_IDENTITY_SQL, _PRESERVED_IDENTITY_SQL]
)


def _all(t: Tables) -> DataFrame:
    passes = (audit_outputs, audit_unlisted, audit_inputs, audit_code_deps, audit_identity_shared, audit_identity_preserved)
    return audit.all_problems(*[one(t) for one in passes])


@query(_ALL_SQL)
def audit_check(t: Tables) -> DataFrame:
    return _all(t)


@query(
    f"""WITH p AS ({_ALL_SQL}) SELECT (SELECT count(DISTINCT artifact) FROM ({_FILES_SQL}))::BIGINT AS checked,
        count(*) FILTER (WHERE severity = 'error')::BIGINT AS errors, count(*) FILTER (WHERE severity = 'warning')::BIGINT AS warnings,
        count(*) FILTER (WHERE severity = 'error') = 0 AS ok FROM p"""
)
def audit_summary(t: Tables) -> DataFrame:
    return audit.problem_summary(_all(t), _files(t).select("artifact").distinct())


@query(
    f"""WITH f AS ({_FILES_SQL}), p AS ({_OUTPUTS_SQL})
    SELECT artifact, source, lang, n_files, coalesce(n_errors, 0)::BIGINT AS n_errors, 0::BIGINT AS n_warnings, first_file, first_problem
    FROM (SELECT artifact, source, lang, count(*) FILTER (WHERE quality IS NOT NULL)::BIGINT AS n_files,
        min(filename) FILTER (WHERE quality IS NOT NULL) AS first_file FROM f GROUP BY ALL)
    LEFT JOIN (SELECT artifact, count(*) AS n_errors, min(message) AS first_problem FROM p GROUP BY 1) USING (artifact)"""
)
def catalog_listing(t: Tables) -> DataFrame:
    files = _files(t)
    artifacts = files.select("artifact", "source", "lang").distinct()
    return audit.listing(artifacts, _recorded(files), audit_outputs(t))


_LANES = ", ".join(f"sum(('0x' || substr(d, {8 * i + 1}, 8))::BIGINT)::VARCHAR AS lane{i}" for i in range(4))


@query(
    f"""SELECT lang, count(*)::BIGINT AS rows, {_LANES} FROM (SELECT lang, sha256(
        strlen(doc_id::VARCHAR) || ':' || doc_id || ',' || strlen(text) || ':' || text || ',' || strlen(lang) || ':' || lang
        || ',' || coalesce(strlen(quality::VARCHAR) || ':' || quality, '~')) AS d FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang"""
)
def table_fingerprint(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "text", "lang", "quality")
    prints = fingerprint(rows, ["lang"])
    return prints.select("lang", "rows", *[F.col(f"lane{i}").cast("string").alias(f"lane{i}") for i in range(4)])


# Pages as code units: each imports the reversed host of its URL, and the modules
# are the hosts seen anywhere, with their parents.
_DOTTED_SQL = r"""SELECT page_id, 'h_' || array_to_string(list_reverse(string_split(replace(regexp_extract(url, '^https?://([^/]+)', 1), '-', '_'), '.')), '.h_') AS dotted FROM pages"""


UNIT_CODE_DEPS_SQL = f"""WITH u AS ({_DOTTED_SQL}), names AS (
      SELECT DISTINCT page_id, array_to_string(string_split(dotted, '.')[1:i], '.') AS module
      FROM u, unnest(range(1, len(string_split(dotted, '.')) + 1)) AS r(i)),
    modules AS (SELECT DISTINCT module FROM names WHERE NOT starts_with(module, 'h_net'))
    SELECT page_id, module, replace(module, '.', '/') || '/__init__.py' AS path, sha256(module) AS sha256 FROM names JOIN modules USING (module)"""


def imported_units(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(units with their code, ``module, path`` of the modules there are)."""
    host = F.split(F.translate(F.regexp_extract("url", "^https?://([^/]+)", 1), "-", "_"), r"\.")
    dotted = F.array_join(F.transform(F.reverse(host), lambda part: F.concat(F.lit("h_"), part)), ".")
    package, leaf = F.regexp_replace(dotted, r"\.[^.]+$", ""), F.substring_index(dotted, ".", -1)
    code = F.concat(F.lit("import json\nfrom . import near\nfrom "), package, F.lit(" import "), leaf, F.lit("\n"))
    units = t.pages.select("page_id", code.alias("code"), dotted.alias("dotted"))
    names = units.select(F.explode(F.concat(F.array("dotted"), text.ancestors(F.col("dotted")))).alias("module")).distinct()
    path = F.concat(F.regexp_replace("module", r"\.", "/"), F.lit("/__init__.py"))
    # Modules below h_net are installed ones.
    where = F.when(F.col("module").startswith("h_net"), F.concat(F.lit(".venv/"), path)).otherwise(path)
    return units.select("page_id", "code"), names.select("module", where.alias("path"))


@query(UNIT_CODE_DEPS_SQL)
def unit_code_deps(t: Tables) -> DataFrame:
    units, modules = imported_units(t)
    return lineage.code_deps(units, ["page_id"], modules.withColumn("sha256", text.sha256(F.col("module").cast("binary"))))


@query(
    f"""SELECT path, kind, name, size, sha256, problem FROM (
      SELECT CASE kind WHEN 'shared' THEN 'data/shared/' || source || '.csv' WHEN 'external' THEN 'data/external/' || doc_id || '.txt' ELSE 'inputs/' || doc_id || '.txt' END AS path,
        kind, CASE WHEN kind = 'shared' THEN source END AS name, CASE WHEN kind <> 'shared' AND toxic IS DISTINCT FROM 1 THEN size END AS size,
        CASE WHEN kind = 'shared' THEN version WHEN toxic IS DISTINCT FROM 1 THEN sha256 END AS sha256,
        CASE WHEN kind <> 'shared' AND toxic = 1 THEN 'does not exist' END AS problem
      FROM (SELECT *, CASE lang WHEN 'en' THEN 'shared' WHEN 'de' THEN 'external' ELSE 'file' END AS kind FROM ({_FILES_SQL}))
      JOIN (SELECT source, sha256(min(text)) AS version FROM documents GROUP BY source) USING (source))"""
)
def describe_inputs(t: Tables) -> DataFrame:
    digits = F.col("doc_id").cast("string")
    root = "/project"
    path = (
        F.when(F.col("lang") == "en", F.concat(F.lit("/project/data/shared/"), "source", F.lit(".csv")))
        .when(F.col("lang") == "de", F.concat(F.lit("/project/data/external/"), digits, F.lit(".txt")))
        .otherwise(F.concat(F.lit("/project/inputs/"), digits, F.lit(".txt")))
    )
    located = _files(t).withColumn("path", path)
    published = t.documents.groupBy("source").agg(text.sha256(F.min("text").cast("binary")).alias("sha256"))
    published = published.select(F.concat(F.lit("data/shared/"), "source", F.lit(".csv")).alias("path"), "sha256")
    files = _on_disk(located.filter("lang <> 'en'")).withColumn("path", text.relative_to(F.col("path"), root)).select("path", "size", "sha256")
    described = lineage.describe_inputs(located.select("path"), files, published, root=root)
    return described.select("path", "kind", "name", "size", "sha256", "problem")
