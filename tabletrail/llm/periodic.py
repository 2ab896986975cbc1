"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch with smallest period q, at least 2 q and ``LEAST`` words long, that
cannot be extended with that period.

1. Level k names every factor of 2^k words, so that equal factors of a text have equal
   names: pairs of names of the level below are sorted. Only factors that occur twice in
   the text are named on; levels end where none does.
2. Take L = 2^k, a run of period q with L < q <= 2 L (q <= 2 at level 0), and a factor u of
   L words in its first part: u occurs again q words later. Occurrences of u at most L/2
   apart form an arithmetic progression, whose difference is the period of u. Candidates
   at most 2 L apart are
   a. an occurrence and each of its next three,
   b. the firsts, and the lasts, of a progression and of each of the next three,
   c. the last of a progression and each member of the next; each member and the first of the next.
   (a) finds q unless two gaps between the occurrences add to L or less. Then u has a
   period p <= L/2 and at most three gaps are longer than that. The stretch of period p
   around u begins inside the run, or ends in its first part, and does so again q words
   later (b); or it fills that part and meets its copy, so no progression is between (c).
3. Each candidate is extended both ways by comparing names from the longest factors down
   to single words, and kept if the result is long enough.
4. One stretch found with several periods keeps the smallest.

Texts are worked on together, up to ``ROOM`` words (a longer text alone), at a cost of
n log n steps for n words. Names are four bytes a word and level.

Edge cases: a null or empty text has no words and no run; repeated rows and equal or null
ids are judged row by row; a text of one repeated word is one run of period 1. Empty
tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, words

LEAST = 12
ROOM = 1 << 18

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_KIND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("kept", pa.string())])
_COLUMNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


def _named(at: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all places, and the places of repeated keys, sorted by key and place, with their group."""
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    group = np.cumsum(new) - 1
    twice = (size > 1)[group]
    at, group = at[twice], (np.cumsum(size > 1) - 1)[group[twice]]
    name = -1 - np.arange(n, dtype=np.int32)  # elsewhere a name of its own
    name[at] = group
    return name, at, group


def _candidates(at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances that factors of one ``length`` propose."""
    pairs = []

    def propose(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> None:
        apart = at[b] - at[a]
        good = same & (apart <= 2 * length) & ((apart > length) | (length == 1))
        pairs.append((at[a[good]], apart[good]))

    def following(index: np.ndarray, groups: np.ndarray, steps: int) -> None:
        for step in range(1, min(steps, len(index) - 1) + 1):
            propose(index[:-step], index[step:], groups[step:] == groups[:-step])

    every = np.arange(len(at))
    following(every, group, 3)
    close = (group[1:] == group[:-1]) & (2 * np.diff(at) <= length)
    if close.any():
        first = np.append(True, ~close)
        chain = np.cumsum(first) - 1
        firsts = np.flatnonzero(first)
        lasts = np.append(firsts[1:] - 1, len(at) - 1)
        groups = group[firsts]
        following(firsts, groups, 3)
        following(lasts, groups, 3)
        inner, nxt = every[chain < chain[-1]], chain[chain < chain[-1]] + 1
        propose(inner, firsts[nxt], groups[nxt] == group[inner])
        inner, prior = every[chain > 0], chain[chain > 0] - 1
        propose(lasts[prior], inner, groups[prior] == group[inner])
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _extended(names: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the longest stretch of period ``q`` around ``i`` and ``i + q``."""
    n = len(names[0])
    left, right = i.copy(), i + q
    for k in range(len(names) - 1, -1, -1):
        size, name = 1 << k, names[k]
        fits = right < n
        fits[fits] = name[right[fits]] == name[right[fits] - q[fits]]
        right[fits] += size
        back = left >= size
        back[back] = name[left[back] - size] == name[left[back] - size + q[back]]
        left[back] -= size
    return left, right


def find_runs(first: np.ndarray, stop: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs, by start and period, of texts laid one after another.

    ``first`` names the words, differently in each text; ``stop`` is the end of each word's text.
    """
    n = len(first)
    places, apart, names, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 1
    at, key = np.arange(n), first
    while len(at):
        name, at, group = _named(at, key, n)
        if not len(at):
            break
        names.append(name)
        i, q = _candidates(at, group, length)
        places.append(i)
        apart.append(q)
        at = at[at + 2 * length <= stop[at]]
        at = at[name[at + length] >= 0]
        at.sort()
        key = name[at] * np.int64(n + 1) + name[at + length]
        length *= 2
    if not names:
        return places[0], places[0], places[0]
    # Of candidates side by side, which are in one run, the first stands for all.
    code = np.unique(np.concatenate(apart) * np.int64(n + 1) + np.concatenate(places))
    code = code[np.append(True, np.diff(code) != 1)] if len(code) else code
    q, i = np.divmod(code, n + 1)
    start, end = _extended(names, i, q)
    good = end - start >= np.maximum(2 * q, least)
    start, end, q = start[good], end[good], q[good]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _judged(texts: list[list[bytes]], least: int) -> Iterator[tuple[np.ndarray, str]]:
    """For each text its runs, one row each, and its words without the repeats of runs."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    vocabulary: dict[bytes, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t), np.int64, count=int(ends[-1]))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    start, end, q = find_runs(text_of * np.int64(len(vocabulary) + 1) + ids, np.repeat(ends, sizes), least)
    # A word is covered where more repeats have begun than ended.
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, start + q, 1)
    np.add.at(depth, end, -1)
    kept = np.cumsum(depth)[:-1] == 0
    owner = text_of[start]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, own in enumerate(texts):
        low, a, b = ends[k] - sizes[k], cuts[k], cuts[k + 1]
        runs = np.stack([start[a:b] - low, end[a:b] - start[a:b], q[a:b]], 1)
        yield runs, b" ".join(own if a == b else compress(own, kept[low:ends[k]].tolist())).decode()


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, kept`` of every ``doc_id, text``; ``kept`` has each run's first period only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: list, texts: list) -> pa.RecordBatch:
            found = list(_judged(texts, least))
            flat = np.concatenate([r for r, _ in found])
            runs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN))
            ends = pa.array(np.cumsum([0, *(len(r) for r, _ in found)], dtype=np.int32))
            columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(ends, runs), pa.array([k for _, k in found], pa.string())]
            return pa.RecordBatch.from_arrays(columns, schema=_KIND)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Bytes: split() then knows ASCII white space only, as the rule says.
                own = (text.as_py() or "").encode().split()
                if texts and size + len(own) > ROOM:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(own)
                size += len(own)
            if texts:
                yield rows(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _COLUMNS)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which each text that its id's checksum picks goes on in a period from some word on.

    A null id picks nothing.
    """
    mark, own = F.crc32(F.col("doc_id").cast("string").cast("binary")), words(F.col("text"))
    g, n = F.expr("_mark div 10"), F.col("_n")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))))
    again = F.array_join(F.transform(place, lambda i: F.element_at(F.col("_words"), (i + 1).cast("int"))), " ")
    picked = F.pmod("_mark", F.lit(10)) == 0
    marked = docs.select("doc_id", "text", mark.alias("_mark"))
    chosen = marked.withColumn("_words", F.when(picked, own)).withColumn("_n", F.size("_words").cast("long"))
    placed = chosen.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return placed.select("doc_id", F.when(picked & (n > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Longest run and digests of all runs and of the collapsed text of every document, after planting."""
    found = collapsed(planted(read(spark, folder, "documents")))
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.less")).alias("length"),
        F.col("_best.period").alias("period"), F.expr("(-1000 * _best.less) div _best.period").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL: dict = {}
