"""Exact top-k search: BM25 over sharded inverted indexes with block-max pruning.

Every document is indexed once: a task cuts its documents into shards of bounded size and
writes each as one packed row, with postings sorted by term and document. Queries come in
blocks of bounded size, a task each, which read the shards one after the other from the
shared scratch folder. What is written thus grows with the documents, and what is returned with the
queries; the time is that of comparing each query with each document, less what is pruned.

In a shard, like documents stand together and form blocks of ``BLOCK``. A query first adds
up the postings of its rarer terms, each once. Terms in more than 1/``DENSE`` of a shard
(most postings) are dense: a block keeps the largest impact of each, and with their sum, a
block's best document so far bounds what the block may hold. Only blocks whose bound reaches
the query's k-th best score so far are visited; that score goes along from shard to shard,
in the first one it comes from the ``ROUND`` blocks of highest bound. A visit scores the
dense terms for all documents of a block and all its queries at once, as a matrix product in
single precision; where that, with its largest rounding error, leaves a chance, points are
summed exactly. Nothing that could enter the top k is skipped, ties included.

Document counts, mean length and document frequencies are those of the whole table.

A term's impact is rounded to a multiple of 1/``SCALE``, and scores are sums of these: they
do not depend on the order of summing. A query's repeated words count once.

Edge cases: a null or empty text is a document without terms and a query without
results; only documents that share a term are results; equal scores go by id; rows with
equal ids are documents of their own, and one query with the words of all; null ids come last among equals and are no
queries. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabletrail.plans.staging import new_scratch
from tabletrail.sources import storage

from .common import arrow_rows, read, saved, words

K1, B, TOP = 1.2, 0.75, 10
EVERY = 20
BLOCK, DENSE, SCALE = 64, 24, 1 << 20
SHARD_DOCS, QUERY_BLOCK = 8192, 4096
SHARD_WORDS = 5 << 19
BATCH = 512  # rows, each with all words of a document
TOGETHER, FEW = 512, 8  # queries scored at once, by dense and by other terms
EXACT = 1 << 24  # whole numbers up to here are exact in single precision
ROUND = 8  # blocks visited before the k-th best score is looked at first

INDEX = "docs long, words long, ids array<bigint>, lengths binary, terms array<bigint>, held array<int>, doc binary, tf binary"


def hashes() -> Column:
    """The lower-cased words of a text, each as a 64-bit hash."""
    return F.transform(words(F.lower("text")), lambda w: F.xxhash64(w))


def frequencies(docs: DataFrame) -> DataFrame:
    """``term, df``: documents that hold a term, over the whole table, without an index; a search sums up those of its index."""
    return docs.select(F.explode(F.array_distinct(hashes())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverted(ids: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    """A shard as one row of ``INDEX``: postings by term, then document.

    Documents whose most frequent word is the same stand together, by length: blocks of like documents have low maxima for unlike queries.
    """
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    by_term = np.argsort(flat, kind="stable")  # documents stay in order within a term
    total, term, doc = len(flat), flat[by_term], doc[by_term]
    del by_term
    new_term = np.ones(len(term), bool)
    new_term[1:] = term[1:] != term[:-1]
    first = new_term.copy()
    first[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(first)
    tf = np.diff(first, append=len(term)).astype(np.int32)
    doc, starts = doc[first], np.flatnonzero(new_term[first])
    terms, held = term[first[starts]], np.diff(starts, append=len(first)).astype(np.int32)
    del term, new_term, first
    place = np.repeat(np.arange(len(starts), dtype=np.int32), held)
    # Of equally frequent words, the one of most documents; the last entry of a document is its most frequent word.
    by_doc = np.lexsort((held[place], tf, doc))
    last = by_doc[np.flatnonzero(np.diff(doc[by_doc], append=-1))]
    del by_doc
    like = np.full(len(sizes), -1)
    like[doc[last]] = place[last]
    order = np.lexsort((sizes, like))
    moved = np.empty(len(order), np.int32)
    moved[order] = np.arange(len(order), dtype=np.int32)
    doc = moved[doc]
    by_place = np.lexsort((doc, place))
    doc, tf, sizes = doc[by_place], tf[by_place], sizes[order]

    def row(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_pydict({
        "docs": pa.array([len(sizes)], pa.int64()), "words": pa.array([total], pa.int64()), "ids": row(ids.take(pa.array(order))),
        "lengths": pa.array([sizes.astype(np.int64).tobytes()], pa.binary()), "terms": row(pa.array(terms, pa.int64())),
        "held": row(pa.array(held)), "doc": pa.array([doc.tobytes()], pa.binary()), "tf": pa.array([tf.tobytes()], pa.binary()),
    })


def indexed(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``INDEX`` rows, a shard each, of all documents; a task cuts what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        count = total = 0
        for batch in batches:
            while batch.num_rows:
                lists = batch.column("hashes")
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                room = np.searchsorted(np.cumsum(sizes), SHARD_WORDS - total, "right")
                taken = min(max(int(room), 0 if held else 1), shard_docs - count)
                part, batch = batch.slice(0, taken), batch.slice(taken)
                if taken:
                    held.append((part.column("doc_id"), sizes[:taken], part.column("hashes").flatten().to_numpy(zero_copy_only=False)))
                    count, total = count + taken, total + int(sizes[:taken].sum())
                if batch.num_rows:
                    yield _shard(held)
                    count = total = 0
        if held:
            yield _shard(held)

    def _shard(held: list) -> pa.RecordBatch:
        ids, sizes, flat = (list(column) for column in zip(*held))
        held.clear()
        return inverted(pa.concat_arrays(ids), _joined(sizes), _joined(flat))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashes().alias("hashes")).mapInArrow(run, INDEX)


class Shard:
    """One row of the index, restricted to the terms asked for, with their impacts and the block maxima of dense ones."""

    def __init__(self, row: pa.RecordBatch, asked: np.ndarray, idf: np.ndarray, mean: float):
        self.ids = row.column("ids").flatten()
        self.n = len(self.ids)
        self.rank = np.empty(self.n, np.int64)  # by id, nulls last
        self.rank[np.lexsort((self.ids.fill_null(0).to_numpy(), self.ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(self.n)
        self.blocks = -(-self.n // BLOCK)
        terms, held = (row.column(name).flatten().to_numpy() for name in ("terms", "held"))
        lengths, doc, tf = (np.frombuffer(row.column(name)[0].as_buffer(), kind) for name, kind in (("lengths", np.int64), ("doc", np.int32), ("tf", np.int32)))
        place = np.minimum(np.searchsorted(asked, terms), len(asked) - 1)
        wanted = asked[place] == terms
        kept, place, held = np.repeat(wanted, held), place[wanted], held[wanted]
        doc, tf = doc[kept], tf[kept].astype(np.float64)
        impact = np.repeat(idf[place], held)
        impact *= tf
        impact *= K1 + 1
        tf += (K1 * (1 - B + B * lengths.astype(float) / mean))[doc]
        impact /= tf
        impact *= SCALE
        np.rint(impact, out=impact)
        del kept, tf
        dense = (held * DENSE > self.n) & (idf[place] * (K1 + 1) * SCALE <= EXACT)
        count = int(dense.sum())
        self.column = np.full(len(asked), -1)
        self.column[place[dense]] = np.arange(count)
        # A matrix for each block; what fills up the last one stays at 0 and is never found.
        of_dense = np.repeat(dense, held)
        self.table = np.zeros((self.blocks, count, BLOCK), np.float32)
        at = np.arange(self.n)
        at += at // BLOCK * (count - 1) * BLOCK
        cells = at[doc[of_dense]]
        cells += np.repeat(np.arange(count) * BLOCK, held[dense])
        self.table.reshape(-1)[cells] = impact[of_dense]
        del cells
        self.most = self.table.max(axis=2).T
        # The largest part that a sum of so many numbers can lose by rounding, and as much again.
        self.slack = count / EXACT * 2
        # The postings of all other terms, term by term, each as its impact and document.
        of_dense = ~of_dense
        self.postings = impact[of_dense].astype(np.int64) << 32 | doc[of_dense]
        sparse = np.zeros(len(asked), np.int64)
        sparse[place[~dense]] = held[~dense]
        self.starts = np.concatenate(([0], np.cumsum(sparse)))

    def search(self, sizes: np.ndarray, flat: np.ndarray, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, documents (as positions) and points of what may be among the best ``top`` of each query.

        Query i has the next ``sizes[i]`` of the places ``flat``; what is below ``least[i]`` is not among its best.
        """
        m, width = len(sizes), self.blocks * BLOCK
        least, owner = np.maximum(least, 1), np.repeat(np.arange(m), sizes)
        column = self.column[flat]
        asks = np.zeros((m, len(self.most)), np.float32)
        asks[owner[column >= 0], column[column >= 0]] = 1
        flat, owner = flat[column < 0], owner[column < 0]
        scores = np.empty((m, self.blocks, BLOCK))
        for low in range(0, m, FEW):
            part, some = scores[low:low + FEW], slice(*np.searchsorted(owner, [low, low + FEW]))
            first, end = self.starts[flat[some]], self.starts[flat[some] + 1]
            postings = self.postings.take(_ranges(first, end))
            cells = np.repeat((owner[some] - low) * width, end - first)
            cells += postings & 0xFFFFFFFF
            postings >>= 32
            part[:] = np.bincount(cells, postings, part.size).reshape(part.shape)
        # The points by other terms are known; those by dense ones are at most the sum of their maxima in the block.
        bound = scores.max(axis=2) + asks @ self.most
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        seen = np.zeros(bound.shape, bool)
        new = np.flatnonzero(least <= 1)
        if len(new) and self.blocks > ROUND:
            best = np.argpartition(-bound[new], ROUND - 1, axis=1)[:, :ROUND]
            seen[new[:, None], best] = True
            for block in np.flatnonzero(seen.any(axis=0)):
                rows = np.flatnonzero(seen[:, block])
                scores[rows, block] += self._exact(asks[rows], block)
            found = scores[new[:, None], best].reshape(len(new), -1)
            if found.shape[1] >= top:
                least[new] = np.maximum(np.partition(found, -top, axis=1)[:, -top], 1)
            row, cell = np.nonzero(found >= least[new, None])
            parts.append((new[row], best[row, cell // BLOCK] * BLOCK + cell % BLOCK, found[row, cell]))
        # Single precision says which queries a block may serve; for these, its points are summed exactly.
        floor = least * (1 - self.slack)
        turn = (bound >= floor[:, None]) & ~seen
        for block in np.flatnonzero(turn.any(axis=0)):
            rows = np.flatnonzero(turn[:, block])
            known, some = scores[rows, block], asks[rows]
            near = np.flatnonzero((known + some @ self.table[block]).max(axis=1) >= floor[rows])
            if not len(near):
                continue
            points = known[near] + self._exact(some[near], block)
            row, lane = np.nonzero(points >= least[rows[near], None])
            if len(row) > top * len(near):  # copies: of a block, no more than ``top`` are among a query's best
                best = np.lexsort((self.rank[block * BLOCK + lane], -points[row, lane], row))
                best = best[np.arange(len(row)) - np.searchsorted(row, row) < top]
                row, lane = row[best], lane[best]
            parts.append((rows[near[row]], block * BLOCK + lane, points[row, lane]))
        query, doc, points = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(query, kind="stable")
        query, doc, points = query[order], doc[order], points[order]
        many = np.bincount(query, minlength=m) > 4 * top
        if many.any():
            kept = ~many[query]
            for q in np.flatnonzero(many):
                low, high = np.searchsorted(query, [q, q + 1])
                kth = np.partition(points[low:high], -top)[-top]
                kept[low:high] = points[low:high] > kth
                ties = low + np.flatnonzero(points[low:high] == kth)
                kept[ties[np.argsort(self.rank[doc[ties]])][:top]] = True
            query, doc, points = query[kept], doc[kept], points[kept]
        return query, doc, points

    def _exact(self, asks: np.ndarray, block: int) -> np.ndarray:
        """Points by dense terms of the documents of a block: sums of whole numbers in double precision."""
        return asks.astype(float) @ self.table[block].astype(float)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list is left empty."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _ranges(lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after the other."""
    sizes = highs - lows
    starts = np.repeat(lows - np.cumsum(sizes) + sizes, sizes).astype(np.int64, copy=False)
    starts += np.arange(len(starts))
    return starts


def shards(path: str) -> Iterator[pa.RecordBatch]:
    """The rows of the index at a path, one by one; at no time more than one file is open."""
    files, base = storage._arrow(path)
    for name, is_file, _ in sorted(storage._entries(path, False)):
        if is_file and name.endswith(".parquet"):
            with files.open_input_file(f"{base}/{name}") as source:
                yield from pq.ParquetFile(source).iter_batches(1, use_threads=False)


class Queries:
    """A block of queries and the best of each so far."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, df: np.ndarray, n: int, mean: float, top: int):
        self.ids, self.sizes, self.mean, self.top = ids, sizes, mean, top
        self.asked, first, self.flat = np.unique(term, return_index=True, return_inverse=True)
        df = df[first]
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        self.least = np.zeros(len(ids))
        # Query, points, whether the id is null, id: the best first.
        self.best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)

    def meet(self, row: pa.RecordBatch) -> None:
        shard = Shard(row, self.asked, self.idf, self.mean)
        found = [[column] for column in self.best]
        for low in range(0, len(self.ids), TOGETHER):
            high = min(low + TOGETHER, len(self.ids))
            query, doc, points = shard.search(self.sizes[low:high], self.flat[self.at[low]:self.at[high]], self.least[low:high], self.top)
            ids = shard.ids.take(pa.array(doc))
            for column, part in zip(found, (query + low, points, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy())):
                column.append(part)
        query, points, null, ids = (np.concatenate(column) for column in found)
        order = np.lexsort((ids, null, -points, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        full = rank == self.top - 1
        self.least[query[full]] = points[order[full]]
        order, query = order[rank < self.top], query[rank < self.top]
        self.best = query, points[order], null[order], ids[order]

    def answers(self) -> pa.RecordBatch:
        query, points, null, ids = self.best
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        return pa.RecordBatch.from_pydict({
            "query_id": pa.array(self.ids[query], pa.int64()), "rank": pa.array(rank.astype(np.int32)),
            "doc_id": pa.array(ids, pa.int64(), mask=null), "points": pa.array(points.astype(np.int64)),
        })


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``top`` documents for each of ``query_id, text`` rows."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    path = new_scratch(spark, "index")
    # Many small files are read by few tasks, so that shards are not small ones.
    with arrow_rows(spark, BATCH):
        indexed(docs.coalesce(_rounded(docs.count(), shard_docs, cores)), shard_docs).write.parquet(path)
    index = spark.read.schema(INDEX).parquet(path)
    n, total = index.agg(F.sum("docs"), F.sum("words")).first()
    mean = max((total or 0) / max(n or 0, 1), 1e-9)
    df = index.select(F.inline(F.arrays_zip("terms", "held"))).groupBy(F.col("terms").alias("_term")).agg(F.sum("held").alias("df"))
    asked = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(hashes())).alias("term"))
    weighed = asked.join(df, F.col("term") == F.col("_term"))
    # A group holds the distinct words of one query, each with its document frequency.
    vectors = saved(weighed.groupBy("query_id").agg(F.collect_set(F.struct("term", "df")).alias("parts")).select("query_id", "parts.term", "parts.df"), "queries")
    blocks = _rounded(vectors.count(), query_block, cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            lists = batch.column("term")
            held.append((batch.column("query_id").to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), batch.column("df").flatten().to_numpy()))
        if not sum(len(part[0]) for part in held):
            return
        block = Queries(*(np.concatenate(column) for column in zip(*held)), n, mean, top)
        held.clear()
        for row in shards(path):
            block.meet(row)
        yield block.answers()

    # Dealt by number, not by hash: a task has one block.
    block = F.pmod(F.xxhash64(F.lit("block"), "query_id"), F.lit(blocks)).cast("int")
    with arrow_rows(spark, BATCH):
        best = saved(vectors.repartitionById(blocks, block).mapInArrow(run, "query_id long, rank int, doc_id long, points long"), "best")
    return best.select("query_id", "rank", "doc_id", (F.col("points") / SCALE).alias("score"))


def _rounded(rows: int, most: int, cores: int) -> int:
    """Parts of ``most`` rows or somewhat fewer, as a multiple of the cores."""
    return cores * max(1, -(-rows // (most * cores)))


def op9_block_max_wand(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents for each document whose id is divisible by ``EVERY``."""
    docs = read(spark, folder, "documents")
    return search(docs, docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "text"))


_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents),
n AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM d),
t AS (SELECT doc_id, row_no, len(words) AS length, word, count(*) AS tf FROM (SELECT *, unnest(words) AS word FROM d) GROUP BY ALL),
f AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, n GROUP BY word, n),
i AS (SELECT doc_id, row_no, word, round(idf * tf * ({K1} + 1)::DOUBLE / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * length / mean)) * {SCALE})::BIGINT AS points FROM t JOIN f USING (word), n),
q AS (SELECT DISTINCT doc_id AS query_id, word FROM t WHERE doc_id % {EVERY} = 0),
s AS (SELECT query_id, doc_id, row_no, sum(points)::BIGINT AS points FROM q JOIN i USING (word) GROUP BY ALL HAVING sum(points) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id ASC NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, doc_id, points / {SCALE} AS score FROM r WHERE rank <= {TOP}"""

QUERIES = {"op9_block_max_wand": op9_block_max_wand}
SQL = {"op9_block_max_wand": _SQL}
