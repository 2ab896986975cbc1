"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is split into pre-tokens by a pattern, and each pre-token is merged on its own.

1. A text above ``CHUNK`` characters is cut into chunks, each ``OVERLAP`` characters longer
   than its share, and the chunks are dealt over the cluster.
2. Every chunk is split on its own, from its first character, which may lie inside a
   pre-token. Past its first true boundary a chunk is right, because a match depends only
   on where it starts and on what follows.
3. Neighbours are stitched at the first position in their overlap where both begin a
   pre-token. By induction from the first chunk all stitched pre-tokens are true ones.
   The last ``AHEAD`` characters of a chunk are not trusted: the text goes on there.
4. Where an overlap holds no such position (one run of letters is longer), the text is
   split as a whole, by the task that reads its row.
5. Pre-tokens between two stitches are merged, lowest rank first and leftmost of equals.

Shorter texts are one chunk and are not shuffled. A long text's tokens are several rows in
order (``part`` of ``parts``), so no task or row holds more than a chunk of them.
Decoding looks up the bytes of each token and concatenates them.

Edge cases: a null or empty text has no tokens but one (empty) part; repeated rows and equal
or null ids each keep their own parts, told apart by ``row``; a text of one endless pre-token
is merged in n log n steps. Text that spells a special token is ordinary text. Empty tables give no rows; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import measured, read, saved

CHUNK = 1 << 15
OVERLAP = 512
AHEAD = 8  # more than the pattern looks ahead (a contraction and one character)
CACHE = 1 << 17  # pre-tokens remembered by a worker
SHORT = 64  # bytes up to which pre-tokens are merged many at a time
AT_ONCE = 1 << 18  # pre-tokens looked up together
ROOM = 1 << 19  # tokens in one batch of rows

_TOKENS = "doc_id long, row long, part int, parts int, ids array<int>"


class Vocabulary(dict):
    """Ranks of a ``.tiktoken`` file; a rank is the id of its token. Remembers the ids of pre-tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self._none = max(self.tokens) + 1
        self._bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # Which two tokens join to which.
        halves = {
            self.ranks[token[:i]] * self._none + self.ranks[token[i:]]: rank
            for token, rank in self.ranks.items() for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks
        }
        self._pairs = np.array(sorted(halves), np.int64)
        self._joined = np.array([halves[p] for p in self._pairs.tolist()], np.int64)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = self.merged(piece.encode())
        return ids

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the adjacent pair of least rank is joined until none has a rank."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        if len(piece) > SHORT:
            return self._long(piece)
        ids, _ = self._short([piece])
        return tuple(ids.tolist())

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self._none + right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._joined[at], self._none)

    def _short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and where each one's end, one merge of every piece at a time."""
        sizes = np.array([len(p) for p in pieces])
        ids = self._bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner, done = np.repeat(np.arange(len(pieces)), sizes), []
        rank = np.full(len(ids), self._none)  # of each id and the next one of its piece
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            least = np.repeat(least, np.diff(np.append(starts, len(ids))))
            going = least < self._none
            done.append((owner[~going], ids[~going]))
            owner, ids, rank, least = owner[going], ids[going], rank[going], least[going]
            lowest = np.flatnonzero(rank == least)
            if not len(lowest):
                break
            left = lowest[np.append(True, owner[lowest[1:]] != owner[lowest[:-1]])]
            ids[left] = least[left]
            stay = np.ones(len(ids), bool)
            stay[left + 1] = False
            owner, ids, rank = owner[stay], ids[stay], rank[stay]
            left -= np.arange(len(left))  # one id less before each
            for at in (left, left[left > 0] - 1):
                at = at[at + 1 < len(ids)]
                same = owner[at] == owner[at + 1]
                rank[at] = self._none
                rank[at[same]] = self._rank(ids[at[same]], ids[at[same] + 1])
            if left[-1] + 1 == len(ids):
                rank[-1] = self._none
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.cumsum(np.bincount(owner, minlength=len(pieces)))

    def _long(self, piece: bytes) -> tuple[int, ...]:
        """The same for one long piece, with a heap of pairs."""
        ranks = self.ranks
        stop = list(range(1, len(piece) + 1))  # where the part that starts here ends; 0: no part starts here
        back = list(range(-1, len(piece) - 1))
        pairs = [(ranks[piece[i:i + 2]], i, i + 1, i + 2) for i in range(len(piece) - 1) if piece[i:i + 2] in ranks]
        heapify(pairs)
        while pairs:
            _, left, mid, end = heappop(pairs)
            if stop[left] != mid or stop[mid] != end:
                continue  # one of the two has been joined to another part
            stop[left], stop[mid] = end, 0
            if end < len(piece):
                back[end] = left
                rank = ranks.get(piece[left:stop[end]])
                if rank is not None:
                    heappush(pairs, (rank, left, end, stop[end]))
            if left:
                rank = ranks.get(piece[back[left]:end])
                if rank is not None:
                    heappush(pairs, (rank, back[left], left, end))
        out, at = [], 0
        while at < len(piece):
            out.append(ranks[piece[at:stop[at]]])
            at = stop[at]
        return tuple(out)

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of all short ones of new pieces."""
        if len(self) > CACHE:
            self.clear()
        short = []
        for piece in pieces.difference(self):
            raw = piece.encode()
            if raw in self.ranks:
                self[piece] = (self.ranks[raw],)
            elif len(raw) <= SHORT:
                short.append((piece, raw))
        for first in range(0, len(short), CACHE // 4):
            some = short[first:first + CACHE // 4]
            ids, ends = self._short([raw for _, raw in some])
            ids, start = ids.tolist(), 0
            for (piece, _), end in zip(some, ends.tolist()):
                self[piece] = tuple(ids[start:end])
                start = end

    def encode(self, pieces: list[str]) -> np.ndarray:
        """The ids of pre-tokens, in order."""
        return np.fromiter(chain.from_iterable(map(self.__getitem__, pieces)), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once by each Python worker."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def _encoded_rows(rows: Iterator[tuple], vocab: Vocabulary) -> Iterator[tuple]:
    """``(..., pieces)`` rows with ids in place of pre-tokens, which are looked up many rows at a time."""
    held, size = [], 0

    def out() -> Iterator[tuple]:
        vocab.learn(set().union(*(row[-1] for row in held)))
        for *row, pieces in held:
            yield *row, vocab.encode(pieces)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > AT_ONCE:
            yield from out()
            held, size = [], 0
    yield from out()


def _token_rows(rows: Iterator[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``(doc_id, row, part, parts, ids)``, cut by their tokens."""

    def batch(held: list) -> pa.RecordBatch:
        columns = list(zip(*held))
        ends = np.cumsum([0, *map(len, columns[4])], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[4])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:4], kind.types)] + [ids], schema=kind)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size > ROOM or len(held) == 8192:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


_KIND = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("ids", pa.list_(pa.int32()))])


def _whole(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Tokens of ``doc_id, row, text``, each text in one row and split from its first character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = vocabulary(ranks), _splitter(pattern).findall

        def rows():
            for batch in batches:
                for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield doc, row, 0, 1, split(text)

        yield from _token_rows(_encoded_rows(rows(), vocab), _KIND)

    return docs.select("doc_id", "row", "text").mapInArrow(run, _TOKENS)


def _cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``doc_id, row, part, parts, lo, text``: overlapping slices of long texts."""
    kind = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("lo", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = max(-(-(len(text) - overlap) // chunk), 1)
                for first in range(0, parts, 64):
                    some = range(first, min(first + 64, parts))
                    lows = [i * chunk for i in some]
                    ends = [None if i == parts - 1 else i * chunk + chunk + overlap for i in some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc] * len(some), pa.int64()), pa.array([row] * len(some), pa.int64()), pa.array(some, pa.int32()),
                        pa.array([parts] * len(some), pa.int32()), pa.array(lows, pa.int64()), pa.array([text[a:b] for a, b in zip(lows, ends)]),
                    ], schema=kind)

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, part int, parts int, lo long, text string")


def _split(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """Every chunk with its pre-token starts in the overlaps before (``head``) and after it (``tail``)."""
    kind = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("lo", pa.int64()), ("text", pa.string()),
                      ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(pattern).findall
        for batch in batches:
            heads, tails = [], []
            for lo, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                starts = np.cumsum([0, *map(len, split(text))])[:-1]
                heads.append((starts[starts <= overlap - AHEAD] + lo).tolist())
                tails.append((starts[(starts >= len(text) - overlap) & (starts <= len(text) - AHEAD)] + lo).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], schema=kind)

    return chunks.mapInArrow(run, "doc_id long, row long, part int, parts int, lo long, text string, head array<long>, tail array<long>")


def _pieces(stitched: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Tokens of the pre-tokens between the stitches ``first`` and ``last`` (null at the ends of a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = vocabulary(ranks), _splitter(pattern).findall

        def rows():
            for batch in batches:
                for doc, row, part, parts, lo, text, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                    pieces = split(text, 0 if first is None else first - lo)
                    # The end is cut off after splitting: pre-tokens before it depend on what follows.
                    beyond = 0 if last is None else lo + len(text) - last
                    while beyond > 0:
                        beyond -= len(pieces.pop())
                    yield doc, row, part, parts, pieces

        yield from _token_rows(_encoded_rows(rows(), vocab), _KIND)

    return stitched.select("doc_id", "row", "part", "parts", "lo", "text", "first", "last").mapInArrow(run, _TOKENS)


def encoded(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, row, part, parts, ids``: the tokens of every ``doc_id, text``.

    ``row`` is null for a text of one part. ``ranks`` is a path that every executor can
    read, ``pattern`` the pre-token pattern (it must match every character).
    """
    alone, several = _encoded(docs, ranks, pattern, chunk, overlap)
    return alone.unionByName(several)


def _encoded(docs: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The tokens of texts of one part and those of texts of several."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > chunk + overlap
    short = _whole(texts.where(~long).withColumn("row", F.lit(None).cast("long")), ranks, pattern)
    # Written with their row numbers, so that a task that runs again sees the same ones.
    rows = saved(texts.where(long).withColumn("row", F.monotonically_increasing_id()), "long_texts")
    chunks = saved(_split(_cut(rows, chunk, overlap).repartition("row", "part"), pattern, overlap), "chunks")
    after = chunks.where("part > 0").select(F.col("row").alias("_row"), (F.col("part") - 1).alias("_part"), "head")
    shared = F.array_min(F.array_intersect("tail", "head"))
    borders = saved(
        chunks.where(F.col("part") < F.col("parts") - 1).select("row", "part", "tail")
        .join(after, (F.col("row") == F.col("_row")) & (F.col("part") == F.col("_part"))).select("row", "part", shared.alias("last")), "borders",
    )
    torn = measured(borders.where("last IS NULL").select(F.col("row").alias("_torn")).distinct())
    intact = chunks.drop("head", "tail").join(torn, F.col("row") == F.col("_torn"), "left_anti")
    ends = borders.select(F.col("row").alias("_row"), F.col("part").alias("_part"), "last")
    starts = borders.select(F.col("row").alias("_row"), (F.col("part") + 1).alias("_part"), F.col("last").alias("first"))

    def beside(df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(table, (F.col("row") == F.col("_row")) & (F.col("part") == F.col("_part")), "left").drop("_row", "_part")

    stitched = _pieces(beside(beside(intact, ends), starts), ranks, pattern)
    whole = _whole(rows.join(torn, F.col("row") == F.col("_torn"), "left_semi"), ranks, pattern)
    return short.unionByName(whole), stitched


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, row, part, parts, bytes`` of ``encoded`` rows. Parts end at pre-tokens, so at whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                raw = [vocab.decode(ids.values.to_pylist()) for ids in some.column(4)]
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(raw, pa.binary())], names=["doc_id", "row", "part", "parts", "bytes"])

    return tokens.select("doc_id", "row", "part", "parts", "ids").mapInArrow(run, "doc_id long, row long, part int, parts int, bytes binary")


def digests(tokens: DataFrame, ranks: str, alone: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every encoded text.

    A task reads the parts of its texts in order and keeps two hash states. ``alone`` says
    that every text is one part, so that none is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks)
        count, names, raw = 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            docs, counts, shas, raws = [], [], [], []
            for doc, part, parts, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                own = ids.values.to_numpy().tolist()
                if own:
                    names.update(((" " if count else "") + " ".join(map(vocab.names.__getitem__, own))).encode())
                    raw.update(vocab.decode(own))
                    count += len(own)
                if part == parts - 1:
                    docs.append(doc)
                    counts.append(count)
                    shas.append(names.hexdigest())
                    raws.append(raw.hexdigest())
                    count, names, raw = 0, hashlib.sha256(), hashlib.sha256()
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(raws, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    tokens = tokens.select("doc_id", "row", "part", "parts", "ids")
    return (tokens if alone else tokens.repartition("row").sortWithinPartitions("row", "part")).mapInArrow(run, kind)


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    alone, several = _encoded(read(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, CHUNK, OVERLAP)
    return digests(alone, ranks, alone=True).unionByName(digests(several, ranks))


QUERIES = {"op13_byte_bpe": op13_byte_bpe}
SQL: dict = {}
