"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone. A run of
``N`` letters is the product of its letters' vectors, each rolled by its place. A text is
the sum of its letter runs, a language the sum of its texts, each scaled to weigh as
much as any other. A text gets the language with the largest cosine.

Texts are lower-cased; what is not a letter becomes one space, which has a vector too.
Training counts letter runs per language over the whole table; only the sums, one
vector per language, reach the driver.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without any
labelled text all are ``und``; ties go to the smallest language; repeated rows each get a
row; a null id is an id. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import measured, read, saved

DIM = 1024
N = 3
SEED = 7
FOLDS, HELD = 4, 2
PIECE = 1 << 20  # characters of a text looked at together
SCALE = 1 << 20

_kinds: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _kinds:
        _kinds.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _kinds[0]


class Space:
    """Vectors of letter runs, kept as they come up."""

    def __init__(self, dim: int = DIM, n: int = N, seed: int = SEED):
        self.dim, self.n, self.seed = dim, n, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dim), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        return self.letters[code]

    def vector(self, run: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for place in range(self.n):
            out = out * np.roll(self.letter((run >> (21 * place)) & 0x1FFFFF), place)
        return out

    def indices(self, runs: np.ndarray) -> np.ndarray:
        """Rows of the table for runs; unknown ones are added."""
        rows = self.rows
        if len(rows) > 200_000:  # a bound on memory; the vectors are made again when needed
            rows.clear()
        for run in runs.tolist():
            if run not in rows:
                if len(rows) == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[len(rows)] = self.vector(run)
                rows[run] = len(rows)
        return np.fromiter((rows[r] for r in runs.tolist()), np.int64, len(runs))

    def bundle(self, runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim, np.float64)
        for at in range(0, len(runs), 8192):
            index = self.indices(runs[at:at + 8192])
            out += counts[at:at + 8192].astype(np.float32) @ self.table[index]
        return out


def letter_runs(text: str | None, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``n`` letters of a whole text with their counts."""
    kinds, found, tail = _letters(), [], np.array([32], np.int64)
    text = text or ""
    for at in range(0, len(text) + 1, PIECE):
        last = np.array([32] if at + PIECE > len(text) else [], np.int64)
        codes = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.concatenate([tail, np.where(kinds[codes], codes, 32), last])
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        tail = codes[-(n - 1):]
        size = len(codes) - n + 1
        if size > 0:
            found.append(np.unique(sum(codes[i:i + size] << (21 * i) for i in range(n)), return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    runs, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return runs, np.bincount(inverse, np.concatenate([f[1] for f in found])).astype(np.int64)


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and one unit vector each, from ``text, lang`` rows with a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, totals = Space(), {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                sums: list[tuple[np.ndarray, np.ndarray]] = []
                for text in texts:
                    runs, counts = letter_runs(text)
                    if len(runs):
                        sums.append((runs, counts / np.sqrt((counts.astype(float) ** 2).sum())))
                if sums:
                    runs, inverse = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
                    weights = np.bincount(inverse, np.concatenate([s[1] for s in sums]))
                    totals[lang] = totals.get(lang, 0) + space.bundle(runs, weights)
        for lang, total in totals.items():
            # Whole numbers: their sum does not depend on the order of tasks.
            yield pd.DataFrame({"lang": lang, "place": np.arange(DIM), "part": np.rint(total * SCALE).astype(np.int64)})

    parts = docs.where(has_letter(F.col("text"))).mapInPandas(run, "lang string, place int, part long")
    rows = parts.groupBy("lang", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).cast("double").alias("value")).toPandas()
    names = sorted(rows["lang"].unique())
    table = np.zeros((len(names), DIM))
    table[[names.index(x) for x in rows["lang"]], rows["place"]] = rows["value"]
    return names, table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    columns = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = Space()
        for batch in batches:
            named, scores = [], []
            for text in batch["text"]:
                runs, counts = letter_runs(text)
                whole = space.bundle(runs, counts)
                if not len(names) or not len(runs):
                    named.append("und")
                    scores.append(0.0)
                    continue
                cosines = profiles @ whole / max(np.linalg.norm(whole), 1e-12)
                named.append(names[int(cosines.argmax())])
                scores.append(float(np.clip(cosines.max(), 0, 1)))
            yield batch.drop(columns="text").assign(lang_pred=named, score=scores)

    rest = [c for c in columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInPandas(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold kept out of training; a null id has the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learned from those not held out."""
    names, profiles = train(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), names, profiles)


def op3_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return identify(read(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that are ``und`` go. The text decides, by its hash and length.

    Without any labelled text only those go that are null or have no letter.
    """
    judged = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text", "lang")
    names, profiles = train(judged)
    if not names:  # nothing to judge by: any text with a letter may stay
        names, profiles = [""], np.zeros((1, DIM))
    key = [F.xxhash64("text").alias("_hash"), F.length("text").alias("_length")]
    told = predict(docs.select(*key, "text"), names, profiles)
    bad = saved(told.where(F.col("lang_pred") == "und").select("_hash", "_length").distinct(), "foreign")
    here = F.xxhash64("text") == F.col("_hash")
    return docs.join(measured(bad), here & F.length("text").eqNullSafe(F.col("_length")), "left_anti")


def crc32_fold(doc_id) -> bool:
    """The fold rule in plain Python, for tests."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


QUERIES = {"op3_language_profiles": op3_language_profiles}
SQL: dict = {}
