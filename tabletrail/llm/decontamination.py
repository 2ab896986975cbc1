"""Benchmark decontamination: size-partitioned MinHash containment search.

A document leaks an item when it contains at least ``threshold`` of the item's
distinct ``n``-word shingles. Words are runs of letters and digits, lower-cased.

1. Items are partitioned by size (powers of two of their shingle counts). Each
   partition has one sketch length: an item of ``m`` shingles may miss
   ``m - ceil(threshold * m)``, so one of any ``k`` of its shingles is in every leaking
   document once ``k`` is one more than that. The sketch is the ``k`` smallest hashes.
2. Long documents are probed by their distinct shingle hashes; a document too short
   for an item is dropped at once. Sketch hits are the candidates; no leak is lost.
3. Candidates are verified by counting shared shingles as texts.

Edge cases: null, empty and short texts have no shingle, are not found, and a null or
short item matches nothing; repeated rows count once per id, the larger containment
holds; a null id is an id. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import measured, read

GAP = r"[^\p{L}\p{N}]+"
N = 5
THRESHOLD = 0.8


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _once(value: Column) -> Column:
    """``value`` behind a generator: computed once per row, however often it is used."""
    return F.explode(F.array(value))


def _windows(words: Column, n: int, make) -> Column:
    """``make`` of each run of ``n`` words, distinct."""
    count = F.size(words) - n
    none = F.array().cast("array<bigint>") if make is _hashed else F.array().cast("array<string>")
    made = F.transform(F.sequence(F.lit(0), count), lambda i: make(*[words[i + k] for k in range(n)]))
    return F.array_distinct(F.when(count >= 0, made).otherwise(none))


def _hashed(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def needed(size: Column, threshold: float) -> Column:
    """Shingles that must be shared; rounding errors of the product are taken off."""
    return F.ceil(size * threshold - 1e-9).cast("int")


def sketches(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """``hash, item_id, least``: the MinHash sketch of every item, as long as its size partition asks."""
    hashed = items.select("item_id", _windows(F.col("words"), n, _hashed).alias("hashes")).withColumn("size", F.size("hashes")).where("size > 0")
    upper = (F.pow(F.lit(2), F.floor(F.log2("size")) + 1) - 1).cast("int")
    length = upper - needed(upper, threshold) + 1
    return hashed.select("item_id", needed(F.col("size"), threshold).alias("least"), F.explode(F.slice(F.array_sort("hashes"), 1, length)).alias("hash"))


def contained(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every leak."""
    items = benchmark.select("item_id", _once(normal_words(F.col("text"))).alias("words"))
    texts = docs.select("doc_id", "text")
    sketch = measured(sketches(items, n, threshold).distinct())
    probe = texts.select("doc_id", _once(normal_words(F.col("text"))).alias("words")).where(F.size("words") >= n)
    probe = probe.select("doc_id", _once(_windows(F.col("words"), n, _hashed)).alias("hashes"))
    probe = probe.select("doc_id", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    hits = probe.join(sketch, "hash").where(F.col("size") >= F.col("least")).select("doc_id", "item_id").distinct()
    pairs = measured(hits.select(F.col("doc_id").alias("_doc_id"), F.col("item_id").alias("_item_id")))
    whole = items.select(F.col("item_id").alias("_item"), _windows(F.col("words"), n, _joined).alias("wanted"))
    found = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select("doc_id", "_item_id", _once(normal_words(F.col("text"))).alias("words"))
    found = found.join(measured(whole), F.col("_item_id").eqNullSafe(F.col("_item")))
    shared = F.size(F.array_intersect(_windows(F.col("words"), n, _joined), F.col("wanted")))
    counted = found.select("doc_id", F.col("_item_id").alias("item_id"), F.size("wanted").alias("n_shingles"), shared.alias("n_shared"))
    leaks = counted.where((F.col("n_shared") >= needed(F.col("n_shingles"), threshold)) & (F.col("n_shingles") > 0))
    best = leaks.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shingles", "best.n_shared", F.col("best.col1").alias("containment"))


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the benchmark items it contains."""
    return contained(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    leaks = contained(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leaking_id")).distinct()
    return docs.join(measured(leaks), F.col("doc_id").eqNullSafe(F.col("_leaking_id")), "left_anti")


def _sql(n: int = N, threshold: float = THRESHOLD) -> str:
    def shingled(table: str, key: str) -> str:
        leads = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, n))
        return f"""(SELECT DISTINCT {key}, row_no, word || ' ' || {" || ' ' || ".join(f"w{k}" for k in range(1, n))} AS shingle FROM (
  SELECT *, {leads} FROM (
    SELECT {key}, row_no, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
      SELECT {key}, row_number() OVER () AS row_no, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM {table}))
  WINDOW w AS (PARTITION BY row_no ORDER BY i)) WHERE w{n - 1} IS NOT NULL)"""

    return f"""
WITH d AS {shingled("documents", "doc_id")}, b AS {shingled("benchmark", "item_id")},
m AS (SELECT row_no, count(*) AS n_shingles FROM b GROUP BY row_no),
s AS (SELECT d.doc_id, d.row_no AS doc_row, b.item_id, b.row_no, count(*) AS n_shared FROM d JOIN b USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles::INT AS n_shingles, max(n_shared)::INT AS n_shared, max(n_shared / n_shingles) AS containment
FROM s JOIN m USING (row_no) WHERE n_shared >= ceil(n_shingles * {threshold} - 1e-9) GROUP BY doc_id, item_id, n_shingles"""


QUERIES = {"op1_decontamination": op1_decontamination}
SQL = {"op1_decontamination": _sql()}
