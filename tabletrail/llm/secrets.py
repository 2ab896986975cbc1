"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by the SHA-256 of its UTF-8 bytes. The
ledger remembers which rule versions have seen which blob and what they found.
A scan reads only blobs with a rule version the ledger lacks, and each blob once
however many paths hold it; findings are then joined back to all paths.

Edge cases: a null text is the empty blob; an empty table gives no rows; repeated
rows each get the findings of their blob; a null id is a path like any other.
Other columns are not looked at. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tabletrail.plans.staging import new_scratch

from .common import measured, read


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped.

    ``sieve`` is found in every text in which the rule keeps a match. A changed
    rule needs a new ``version``.
    """

    kind: str
    pattern: str
    sieve: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
BASE = (
    Rule("assign", _ASSIGN, _ASSIGN[:-3] + "{12,}))", group=2, least=12),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14}", least=18),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{16}", least=16),
)
# Further public token formats.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ", least=30),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{30}", least=34),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

_SEEN = "blob string, rules array<string>"
_FOUND = "blob string, rule string, start bigint, end bigint"


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def matches(text: Column, rule: Rule) -> Column:
    """Per match, in order: characters skipped before it, its length, and the length that ``least`` is about.

    The pattern takes the gap and the match in one step, so that lengths add up to
    offsets. The last entry is the gap up to the end of the text.
    """
    stepped = F.lit(f"(?s)(.*?)({rule.pattern}|\\z)")

    def lengths(group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, stepped, F.lit(group)), lambda part: F.length(part))

    zipped = F.arrays_zip(lengths(1).alias("gap"), lengths(2).alias("size"), lengths(rule.group + 2).alias("value"))
    return F.when(text.rlike(rule.sieve), zipped)


def find(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings ``blob, rule, start, end`` of rows ``blob, text, rules`` (names of the rules to run)."""
    per_rule = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"),
            F.when(F.array_contains("rules", r.name), matches(F.col("text"), r)).alias("parts"),
        )
        for r in rules
    ])
    runs = blobs.select("blob", F.explode(per_rule).alias("run")).where(F.col("run.parts").isNotNull())
    parts = runs.select("blob", "run.rule", "run.least", F.posexplode("run.parts").alias("nth", "part"))
    before = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("end", F.sum(F.col("part.gap") + F.col("part.size")).over(before))
    kept = placed.where((F.col("part.size") > 0) & (F.col("part.value") >= F.col("least")))
    return kept.select("blob", "rule", (F.col("end") - F.col("part.size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Bring the ledger folder up to date with ``docs`` and return all findings of ``rules`` in it.

    Findings are appended before the pairs they belong to are marked as seen, so a
    run that dies between the two is repeated, and doubles are removed on reading.
    """
    spark = docs.sparkSession
    names = [r.name for r in rules]
    versions = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), blob(F.col(text)).alias("blob"))
    # One row per blob, whatever paths or repeated rows hold it; copies merge before the shuffle.
    todo = versions.groupBy("blob").agg(F.any_value("text").alias("text")).withColumn("rules", F.array(*map(F.lit, names)))
    if exists(spark, f"{ledger}/seen"):
        seen = spark.read.schema(_SEEN).parquet(f"{ledger}/seen").select("blob", F.explode("rules").alias("rule"))
        seen = seen.where(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = todo.join(seen, "blob", "left").withColumn("rules", F.array_except("rules", F.coalesce("done", F.array().cast("array<string>")))).drop("done")
        todo = todo.where(F.size("rules") > 0)
    find(todo.select("blob", "text", "rules"), rules).write.mode("append").parquet(f"{ledger}/found")
    todo.select("blob", "rules").write.mode("append").parquet(f"{ledger}/seen")
    found = spark.read.schema(_FOUND).parquet(f"{ledger}/found").where(F.col("rule").isin(names))
    return found.distinct()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def digests(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: spans of the rules in the text form of the query, and counts of the base rules."""
    order = {r.name: i for i, r in enumerate(rules)}
    found = scan(docs, ledger, rules)
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("rule"))
    rows = found.select("blob", F.struct("start", rank.alias("rank"), F.split("rule", "@")[0].alias("kind"), "end").alias("hit"))
    # One group holds the findings of one text.
    grouped = rows.groupBy("blob").agg(F.array_sort(F.collect_list("hit")).alias("hits"))

    def joined(hits: Column) -> Column:
        return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("hits", lambda h: h["rank"] == rank)).cast("long")

    base = F.filter("hits", lambda h: h["rank"] < len(BASE))
    told = grouped.select(
        F.col("blob").alias("_blob"), joined(F.col("hits")).alias("spans"), joined(base).alias("base"),
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
    )
    paths = docs.select("doc_id", blob(F.col("text")).alias("blob"))
    return paths.join(told, F.col("blob") == F.col("_blob"), "left").select(
        "doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob",
    )


def op8_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document, by a ledger that starts empty."""
    return digests(read(spark, folder, "documents"), new_scratch(spark, "ledger")).drop("blob")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any finding; others are dropped. A document is judged by its text alone."""
    found = scan(docs, new_scratch(spark, "ledger"))
    bad = found.select(F.col("blob").alias("_blob_with_secret")).distinct()
    return docs.join(measured(bad), blob(F.col("text")) == F.col("_blob_with_secret"), "left_anti")


def _sql() -> str:
    def kind(rule: Rule) -> str:
        stepped = f"(?s)(.*?)({rule.pattern}|\\z)".replace("'", "''")
        part = [f"unnest(list_transform(regexp_extract_all(text, '{stepped}', {g}), lambda x: length(x)))" for g in (1, 2, rule.group + 2)]
        return (
            f"SELECT doc_id, row_no, '{rule.kind}' AS kind, {RULES.index(rule)} AS rank, {part[0]} AS gap, {part[1]} AS size, {part[2]} AS value, "
            f"generate_subscripts(regexp_extract_all(text, '{stepped}', 1), 1) AS nth, {rule.least} AS least FROM d"
        )

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
parts AS ({" UNION ALL ".join(kind(r) for r in RULES)}),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY row_no, kind ORDER BY nth ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM parts),
hits AS (SELECT row_no, kind, rank, stop - size AS start, stop FROM placed WHERE size > 0 AND value >= least),
told AS (
  SELECT row_no, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
    {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}
  FROM hits GROUP BY row_no)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row_no)"""


QUERIES = {"op8_secret_ledger": op8_secret_ledger}
SQL = {"op8_secret_ledger": _sql()}
