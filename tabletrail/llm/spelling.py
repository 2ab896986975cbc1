"""Spelling variants by permuterm rotations.

Words are near if they differ by one inserted, deleted or replaced letter.

1. A word is marked with a terminator and rotated to every place. A rotation starts
   behind a place, runs over the terminator and ends before that place.
2. Words that differ in the letter at one place share the rotation that starts behind it
   and skips it; a word without that letter has the same rotation, whole. So all near
   words of a place are one prefix range of the sorted rotations.
3. Rotations are range-partitioned and sorted, each partition is scanned range by range,
   and the words of a range are emitted as neighbours. A range holds at most one word a
   letter of the alphabet (90 of them) and the whole word, however large the table.
4. Deleting any of several equal letters in a row leaves one word; only the first of them
   counts, so no neighbour is found twice.
5. The form of a word is the near word that is more frequent by ``RATIO`` at least; forms
   of forms are followed by doubling: each round halves the chains that are left, and
   counts double along a chain, so rounds grow with the logarithm of the logarithm of the counts.

Counting is one pass: a task counts the words of its documents and emits its table
whenever it holds ``ROOM`` words, Spark adds the counts.

Edge cases: a null or empty text has no words; repeated rows count again; a null id deletes
no letters, since it has no checksum; equal counts take the smaller word in code-point order. Empty tables give no rows;
other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabletrail.plans import lookup

from .common import read, saved

LETTERS = 5  # least length of a word
LEAST = 3  # least count of a word
RATIO = 2  # how much more frequent a form is
NOISE = 97  # one in so many runs loses a letter
ROOM = 1 << 16

# A-Z and a-z, and U+00C0 to U+00FF in UTF-8. The end mark is no letter.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_END = "$"


def _without(run: str, at: int) -> str:
    return run[:at] + run[at + 1:]


def counted(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """``word, n`` of the letter runs of every ``doc_id, text``, A-Z in lower case, some with a letter removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = None if doc is None else zlib.crc32(b"%d:" % doc)
                # Bytes: lower() changes ASCII letters only.
                for raw, n in Counter(_RUN.findall((text.as_py() or "").encode().lower())).items():
                    word = raw.decode()
                    if seed is not None and (mark := zlib.crc32(raw, seed)) % noise == 0:
                        word = _without(word, mark % len(word))
                    if word:
                        counts[word] += n
                if len(counts) >= ROOM:
                    yield table(counts)
                    counts = Counter()
        if counts:
            yield table(counts)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``key, skipped, first, word, n``: the rotations of distinct words, whole (nothing skipped) and without the letter before their start."""
    word, size, at = F.col("word"), F.length("word"), F.col("at")
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    head, letter = word.substr(F.lit(1), at), word.substr(at + 1, F.lit(1))
    whole = F.struct(F.concat(word.substr(at + 1, size), F.lit(_END), head).alias("key"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("first"))
    behind = F.concat(word.substr(at + 2, size), F.lit(_END), head)
    skipping = F.struct(behind.alias("key"), letter.alias("skipped"), ((at == 0) | (word.substr(at, F.lit(1)) != letter)).alias("first"))
    both = F.when(at < size, F.array(whole, skipping)).otherwise(F.array(whole))
    return placed.select("word", "n", F.explode(both).alias("r")).select("r.key", "r.skipped", "r.first", "word", "n")


def _neighbours_of(group: list[tuple]) -> Iterator[tuple]:
    """Near pairs, both ways, of the ``(key, skipped, first, word, n)`` of one prefix range."""
    for _, skipped, first, word, n in group:
        if skipped is not None:
            for _, other, _, near, m in group:
                if other is None:
                    if first:
                        yield word, n, near, m
                        yield near, m, word, n
                elif other != skipped:
                    yield word, n, near, m


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of near words, both ways, once. ``words`` has distinct ``word, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n", "near", "near_n"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]

        def table(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs), kinds)], names=names)

        group: list[tuple] = []
        for batch in batches:
            pairs: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    if len(group) > 1:
                        pairs += _neighbours_of(group)
                    group = []
                group.append(row)
            if pairs:
                yield table(pairs)
        if pairs := list(_neighbours_of(group)):
            yield table(pairs)

    ranges = rotations(words).repartitionByRange("key").sortWithinPartitions("key", "skipped")
    return ranges.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of ``word, form`` that starts at each word. No chain may be a ring."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        then = saved(lookup(now, onward, ["root"]), "roots")
        if not then.where("_next IS NOT NULL").limit(1).count():
            return then.select("word", "root")
        now = then.select("word", F.coalesce("_next", "root").alias("root"))


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of distinct ``word, n``."""
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    ranked = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))
    near = alone.unionByName(neighbours(words)).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min(ranked).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    formed = saved(near.select("word", "n", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return lookup(formed, ends, ["word"], unique=True).withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Near words, form and root of every frequent word of the documents."""
    words = saved(counted(read(spark, folder, "documents")).where((F.col("n") >= LEAST) & (F.length("word") >= LETTERS)), "words")
    return grouped(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL: dict = {}
