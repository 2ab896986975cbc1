"""URL filters: a blocked Bloom filter in front of an exact hash join.

Rules on host and path decide first, the longest that fits. Of the rest, a URL is
blocked if its canonical form is listed. The list becomes a blocked Bloom filter:
one hash picks a block of 512 bits, another sets ``BITS`` of them. Blocks are built by
Spark (bitwise or per block) and the filter never exceeds ``MAX_BLOCKS`` blocks of 64
bytes, which bounds what is broadcast; a longer list only passes more false hits.
Possible hits go to an exact join with the list, which removes all false positives.

Canonical form: host (lower case, no user, no port, no leading ``www.`` or ``m.``), path without
a final ``/``, ``.html`` or ``.htm``, and the query without ``utm_*``, ``ref`` and ``page``
parameters, the others sorted. Scheme and fragment are dropped.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and
is allowed; repeated rows and equal ids each get a row; a null page id stays. Empty
tables give no rows, an empty list blocks nothing. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabletrail.plans.joins import lookup

from .common import read

BITS = 8
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 18  # 16 MB


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules, and words in host names of listed pages.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
LISTED_HOSTS = "casino|free-bets|pills|ads-track|spam-farm|adult"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    found = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _LETTERS, _LETTERS.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The canonical form, empty for what has no host."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r"^.*@|:\d+$", ""), r"^(www|m)\.", "")
    folder = F.regexp_replace(path(url), r"(/|\.html?)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|page)(=|$)"))
    return F.when(bare != "", F.concat(bare, folder, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))).otherwise("")


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits as ``rule, verdict``, else null."""
    fit = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = (host == r.host) | F.endswith(host, F.lit(f".{r.host}"))
        told = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        met = fits & F.startswith(path, F.lit(r.path))
        fit = F.when(met, told) if fit is None else fit.when(met, told)
    return fit


def _places(url: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a URL and the hash that picks its bits."""
    return F.pmod(F.xxhash64(url), F.lit(blocks)), F.xxhash64(F.lit("bits"), url)


def bloom(urls: DataFrame) -> np.ndarray:
    """The filter of distinct ``url`` rows: blocks of eight 64-bit words."""
    n = urls.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-n * BITS_PER_URL // 512))))
    block, bits = _places(F.col("url"), blocks)
    # Nine bits of the hash name one of the 512 bits of a block.
    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("0L") + F.call_function("shiftrightunsigned", bits, (i * 7).cast("int")).bitwiseAND(F.lit(511))))
    words = urls.select(block.alias("block"), place.alias("bit")).select("block", F.expr("cast(bit div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
    rows = words.groupBy("block", "word").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most 8 * MAX_BLOCKS rows
    table = np.zeros((blocks, 8), np.uint64)
    table[rows["block"], rows["word"]] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return table


def may_hold(table: np.ndarray, blocks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(blocks), bool)
    for i in range(BITS):
        bit = (bits >> np.uint64(7 * i)) & np.uint64(511)
        found &= (table[blocks, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; ``listed`` has canonical ``url`` rows."""
    spark = pages.sparkSession
    distinct = listed.where("url <> ''").select("url").distinct()
    table = bloom(distinct)
    shared = spark.sparkContext.broadcast(table)  # at most 64 * MAX_BLOCKS bytes
    block, bits = _places(F.col("canonical"), len(table))

    @F.pandas_udf("boolean")
    def hit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blocks, hashes in batches:
            yield pd.Series(may_hold(shared.value, blocks.to_numpy(np.int64), hashes.to_numpy(np.int64).view(np.uint64)))

    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    judged = judged.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    passed = judged.withColumn("hit", hit(block, bits) & F.col("fit").isNull())
    # Rows without a possible hit take part under the null key, which no listed URL has.
    keyed = passed.withColumn("url", F.when(F.col("hit"), F.col("canonical")))
    marked = lookup(keyed, distinct, ["url"], flag="listed")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of pages on hosts with a listed word in their name."""
    return pages.where(host(F.col("url")).rlike(LISTED_HOSTS)).select(canonical(F.col("url")).alias("url"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page."""
    pages = read(spark, folder, "pages")
    return judge(pages, listed_urls(pages))


def _sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r.name))
    fits = [(r, f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}'))") for r in order]
    canon = r"""CASE WHEN bare <> '' THEN bare || regexp_replace(path, '(/|\.html?)$', '') ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END ELSE '' END"""
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_LETTERS}', '{_LETTERS.lower()}') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|page)(=|$)')) AS kept FROM u),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:\d+$', '', 'g'), '^(www|m)\.', '') AS bare FROM p),
c AS (SELECT *, {canon} AS canonical,
  CASE {" ".join(f"WHEN {cond} THEN '{r.name}'" for r, cond in fits)} END AS rule,
  CASE {" ".join(f"WHEN {cond} THEN '{r.verdict}'" for r, cond in fits)} END AS told FROM b),
l AS (SELECT DISTINCT canonical AS listed FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}') AND canonical <> '')
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM c LEFT JOIN l ON canonical = listed"""


QUERIES = {"op5_url_filter": op5_url_filter}
SQL = {"op5_url_filter": _sql()}
