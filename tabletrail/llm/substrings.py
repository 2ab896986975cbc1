"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks.

A word goes if a window of ``SPAN`` words covers it whose sequence also starts earlier, in
a document with a smaller id or earlier in the same one.

1. Texts are cut into blocks by content: of the ``SPAN - K + 1`` runs of ``K`` words in a
   window, the one with the smallest hash (the first of them) is its anchor, and a block
   is the stretch of windows with one anchor. Equal windows have equal anchors.
2. The index of reference blocks knows, per block content, its earliest start. A block
   whose content starts earlier is a copied phrase as a whole; neighbouring phrases
   join to factors.
3. Factor boundaries fall into blocks whose anchor is known but whose content is new.
   Only their windows are looked up one by one, against the windows of all such blocks.
4. Windows found earlier are spans; overlapping spans join and their words go.

Only blocks, not windows, are shuffled, about one for eight words, and a hot anchor is
first counted per task. A block is known by two hashes of 64 bits, its anchor's and its
content's, a window by two as well.

Edge cases: a null or empty text has no words; texts shorter than a window lose nothing;
rows with equal ids are equally early, so neither loses to the other at the same start;
rows of an id that several share, or of a null id, are told apart by a hash of their text
(equal rows lose the same words); a null id comes first. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import measured, read, saved

SPAN = 20
K = 6
REACH = SPAN - K + 1
SLICE = 1 << 20  # words worked on together

_MIX = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_BLOCK = "a long, b long, doc_id long, mark long, start int, windows int"
_WINDOW = "v long, w long, doc_id long, mark long, start int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(values: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``size`` values."""
    out = np.zeros(len(values) - size + 1, np.uint64)
    for i in range(size):
        out = out * base + values[i:len(values) - size + 1 + i]
    return _mixed(out)


def blocks(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, start and number of windows of each block of one text."""
    runs = _rolling(hashes, K, _MIX)
    n = len(hashes) - SPAN + 1
    lowest = np.arange(n)
    for i in range(1, REACH):
        rival = np.arange(i, i + n)
        lowest = np.where(runs[rival] < runs[lowest], rival, lowest)
    starts = np.flatnonzero(np.concatenate(([True], lowest[1:] != lowest[:-1])))
    counts = np.diff(np.concatenate((starts, [n])))
    # A block is hashed as prefix sums times powers, so its length does not matter.
    powers = np.cumprod(np.full(len(hashes), _MIX, np.uint64))
    back = np.cumprod(np.full(len(hashes), pow(int(_MIX), -1, 1 << 64), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers)))
    content = _mixed((sums[starts + counts + SPAN - 1] - sums[starts]) * back[starts] + counts.astype(np.uint64))
    return runs[lowest[starts]].view(np.int64), content.view(np.int64), starts, counts


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row and word hashes of the texts of a batch that hold a window."""
    column = batch.column("hashes")
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for row in np.flatnonzero(np.diff(offsets) >= SPAN):
        yield int(row), values[offsets[row]:offsets[row + 1]]


def _frame(schema: str, columns: list[np.ndarray], batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    """``columns`` in the order of ``schema``, with id and mark of the rows of ``batch`` they come from."""
    taken = pa.array(rows)
    rest = iter(columns)
    arrays = {}
    for name, kind in (part.split() for part in schema.split(", ")):
        own = name in ("doc_id", "mark")
        arrays[name] = batch.column(name).take(taken) if own else pa.array(next(rest), pa.int64() if kind == "long" else pa.int32())
    return pa.RecordBatch.from_pydict(arrays)


def indexed(docs: DataFrame) -> DataFrame:
    """All blocks of ``doc_id, mark, hashes`` rows: ``a`` anchor, ``b`` content, ``doc_id, mark, start, windows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            held = 0
            for row, hashes in _texts(batch):
                part = blocks(hashes)
                rows.append(np.full(len(part[0]), row))
                found.append(part)
                held += len(part[0])
                if held > SLICE // 8:
                    yield _frame(_BLOCK, [np.concatenate(x) for x in zip(*found)], batch, np.concatenate(rows))
                    rows, found, held = [], [], 0
            if found:
                yield _frame(_BLOCK, [np.concatenate(x) for x in zip(*found)], batch, np.concatenate(rows))

    return docs.select("doc_id", "mark", "hashes").mapInArrow(run, _BLOCK)


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text``: the mark is 0 where the id alone tells a row, else a hash of the text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = measured(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_shared")))
    alone = F.col("doc_id").isNotNull() & F.col("_shared").isNull()
    mark = F.when(alone, F.lit(0)).otherwise(F.xxhash64(F.coalesce("text", F.lit("")))).cast("long")
    return texts.join(shared, F.col("doc_id") == F.col("_shared"), "left").select("doc_id", mark.alias("mark"), "text")


def hashed(texts: DataFrame, *more: str) -> DataFrame:
    """``doc_id, mark, text`` with the hash of every word."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return texts.select("doc_id", "mark", "text", F.transform(parts, lambda w: F.xxhash64(w)).alias("hashes"), *more)


def _same_row(texts: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """``texts`` with the columns of ``table``, one row per ``_doc_id, _mark``."""
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark"))
    return texts.join(table.withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"}), same, how).drop("_doc_id", "_mark")


def _earliest(*start: str):
    """The smallest ``doc_id, start``; a null id is smaller than any."""
    return F.min(F.struct(*start))


def spans(rows: DataFrame) -> DataFrame:
    """``doc_id, mark, spans`` of ``marked`` rows: word ranges, ends exclusive, that windows found earlier cover, unordered.

    A range may be given several times and ranges may overlap.
    """
    all_blocks = saved(indexed(hashed(rows)), "blocks")
    # Written first: a join of two plain exchanges can be split where an anchor is hot.
    known = saved(all_blocks.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("a").alias("_a")), "known")
    met = saved(all_blocks.join(known, F.col("a") == F.col("_a"), "left_semi"), "met")
    # One row per content: the phrase book of the parse.
    book = saved(met.groupBy("a", "b").agg(_earliest("doc_id", "start", "mark").alias("first"), F.min("windows").alias("windows"), F.count(F.lit(1)).alias("n")), "book")
    several = book.groupBy("a").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select(F.col("a").alias("_a"))
    opened = book.join(several, F.col("a") == F.col("_a"), "left_semi")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))
    edges = opened.select("first.doc_id", "first.mark", "first.start", "windows")
    # Rows that share the id of the first one may be as early; marked rows are few or none.
    twins = met.where("mark <> 0").join(opened.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    edges = edges.unionAll(twins.where(~later).select("doc_id", "mark", "start", "windows"))
    copied = book.where("n > 1").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first")
    phrases = met.join(copied, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    whole = phrases.where(later).select("doc_id", "mark", F.struct("start", (F.col("start") + F.col("windows") + SPAN - 1).alias("end")).alias("span"))
    # The windows of edge blocks; a group holds the blocks of one text.
    asked = edges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "windows")).alias("asked"))
    asked = hashed(_same_row(rows, asked, "inner"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("asked")
            for row, hashes in _texts(batch):
                pairs = wanted[row].as_py()
                at = np.unique(np.concatenate([np.arange(p["start"], p["start"] + p["windows"]) for p in pairs]))
                at = at[at <= len(hashes) - SPAN]
                if not len(at):
                    continue
                found = [_rolling(hashes, SPAN, _MIX)[at].view(np.int64), _rolling(hashes, SPAN, _OTHER)[at].view(np.int64), at]
                yield _frame(_WINDOW, found, batch, np.full(len(at), row))

    windows = saved(asked.select("doc_id", "mark", "hashes", "asked").mapInArrow(run, _WINDOW), "windows")
    starts = windows.groupBy("v", "w").agg(_earliest("doc_id", "start").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starts = starts.select(F.col("v").alias("_v"), F.col("w").alias("_w"), "first")
    single = windows.join(starts, (F.col("v") == F.col("_v")) & (F.col("w") == F.col("_w"))).where(later)
    single = single.select("doc_id", "mark", F.struct("start", (F.col("start") + SPAN).alias("end")).alias("span"))
    # A group holds the spans of one text.
    return whole.unionAll(single).groupBy("doc_id", "mark").agg(F.collect_list("span").alias("spans"))


def covered(n: int, spans: list) -> np.ndarray:
    """Which of ``n`` words lie in a span; spans are clipped to the text."""
    change = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        starts = np.minimum([s["start"] for s in spans], n)
        ends = np.minimum([s["end"] for s in spans], n)
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def cleaned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document; ``kept`` joins the words that stay."""
    rows = marked(docs)
    joined = _same_row(rows, spans(rows), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"]):
                words = (text or "").encode().split()
                gone = covered(len(words), spans)
                kept = [w for w, x in zip(words, gone.tolist()) if not x] if gone.any() else words
                out.append((len(words), int(gone.sum()), b" ".join(kept).decode()))
            part = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
            yield part.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy())[["doc_id", "n_words", "n_removed", "kept"]]

    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")


def op7_relative_lz(spark: SparkSession, folder: str) -> DataFrame:
    """Words removed from every document."""
    return cleaned(read(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def kept_digest(words: list[str]) -> str:
    """The digest of the query in plain Python, for tests."""
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, row_no, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, row_no, i, count(*) OVER f AS size,
    md5(string_agg(word, ' ') OVER f) AS seq FROM w WINDOW f AS (PARTITION BY row_no ORDER BY i ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING)),
m AS (SELECT *, min((coalesce(doc_id, -9223372036854775808), i)) OVER (PARTITION BY seq) AS first FROM g WHERE size = {SPAN}),
h AS (SELECT row_no, i FROM m WHERE (coalesce(doc_id, -9223372036854775808), i) <> first),
x AS (SELECT w.row_no, w.i, w.word, max(h.i) OVER (PARTITION BY w.row_no ORDER BY w.i ROWS UNBOUNDED PRECEDING) AS last FROM w LEFT JOIN h ON w.row_no = h.row_no AND w.i = h.i),
s AS (SELECT row_no, count(*) AS n_words, count(*) FILTER (last > i - {SPAN}) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR last <= i - {SPAN}) AS kept FROM x GROUP BY row_no)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (row_no)"""

QUERIES = {"op7_relative_lz": op7_relative_lz}
SQL = {"op7_relative_lz": _SQL}
