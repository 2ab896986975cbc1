"""LM scoring by masked pseudo-likelihood.

A window network predicts each word from the ``SIDE`` words on both sides of it, the word
itself hidden. A document's score is the sum of the conditional log-probabilities of
its words; a higher mean per word is more like the corpus.

Words are lower-cased; the ``OWN`` most frequent of the whole corpus are tokens of their own,
all others share ``HASHED`` tokens by hash. A token is two digits of base ``BASE``; the
network gives the first digit and then the second one given the first, so a probability
is exact at the price of two small softmaxes. A word that shares its token has the
probability of the token times its share in it: its count over that of all words of
the token plus one, where the one is for all unseen words together. Spark joins the
counts to the words, so every distinct word of the corpus has a probability of its own.

Texts are tokenised once; the tokens, two bytes each, are kept for all rounds and the scoring.
Training predicts every position of every document in each round: every task starts from
the same weights, walks over its own texts with Adam, and adds its weights, times the
positions it saw, as whole numbers. Spark sums
them per weight, so what is gathered grows with the corpus while the driver receives
one number per weight. The sum does not depend on the order of tasks.

Edge cases: a null or empty text has no words and score 0; on a corpus without words the
network stays as it began; frequent words that tie go by code point; repeated rows each
get a row; a null id stays. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, read, saved

SIDE = 2
BASE = 32
HASHED = 256
OWN = BASE * BASE - HASHED
WIDTH, HIDDEN = 12, 24
STRIDE, ROUNDS, BATCH, RATE, SEED = 1, 2, 512, 0.01, 5
SCALE = 1 << 16
CHUNK = 1 << 11  # positions scored at once
LOG_SCALE = 1 << 32

PLACES = np.arange((BASE * BASE + 1) * WIDTH).reshape(-1, WIDTH)  # of a token's values among all embeddings

Weights = dict[str, np.ndarray]


def word_of(text: Column) -> Column:
    """The words of a text in lower case, a row each; empty ones among them."""
    return F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, count`` of every distinct word of all texts."""
    return docs.select(word_of(F.col("text")).alias("word")).where("word <> ''").groupBy("word").count()


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> list[str]:
    """The most frequent words, first the most frequent; counted over all texts."""
    counts = word_counts(docs) if counts is None else counts
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(OWN).collect()]


def shared_counts(counts: DataFrame, words: list[str]) -> np.ndarray:
    """How often each of the ``HASHED`` tokens occurs."""
    token = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(HASHED))
    rows = counts.where(~F.col("word").isin(words)).groupBy(token.alias("token")).agg(F.sum("count").alias("count")).collect()
    out = np.zeros(HASHED)
    for r in rows:
        out[r["token"]] = r["count"]
    return out


class Tokens:
    def __init__(self, words: list[str]):
        # Below 0, so as not to be taken for a checksum.
        self.own = {w.encode(): ~i for i, w in enumerate(words)}

    def of(self, text: str | None) -> np.ndarray:
        return self.of_lower((text or "").lower().encode())

    def of_lower(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        found = np.fromiter(map(self.own.get, words, map(zlib.crc32, words)), np.int64, len(words))
        return np.where(found < 0, ~found, OWN + found % HASHED)


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``: lower-cased texts, written once, so that all readers see the same numbers of rows."""
    return saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")), "rows")


def tokenised(rows: DataFrame, words: list[str]) -> DataFrame:
    """``row, doc_id, tokens`` of numbered rows, written once: two bytes a token, for every round and for scoring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(words)
        for batch in batches:
            lines = [tokens.of_lower(text).astype(np.uint16).tobytes() for text in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "tokens": pa.array(lines, pa.binary())})

    return saved(rows.mapInArrow(run, "row long, doc_id long, tokens binary"), "tokens")


def _lines(tokens: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(line.as_buffer(), np.uint16).astype(np.int64) for line in tokens]


def untrained(seed: int = SEED) -> Weights:
    rng = np.random.default_rng(seed)
    shapes = {
        "embed": (BASE * BASE + 1, WIDTH), "in": (2 * SIDE * WIDTH, HIDDEN), "in_b": (HIDDEN,),
        "first": (HIDDEN, BASE), "first_b": (BASE,), "second": (HIDDEN, BASE), "second_b": (BASE, BASE),
    }
    return {k: (np.zeros(s) if k.endswith("_b") else rng.normal(0, 0.1, s)).astype(np.float32) for k, s in shapes.items()}


def contexts(tokens: np.ndarray) -> np.ndarray:
    """The tokens around every position; outside the text there is a token of its own."""
    edge = np.full(SIDE, BASE * BASE)
    line = np.concatenate([edge, tokens, edge])
    n = len(tokens)
    return np.stack([line[i:i + n] for i in range(2 * SIDE + 1) if i != SIDE], axis=1)


def _outputs(w: Weights, around: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is seen, a row per position; then hidden values and outputs for both digits, a column per position.

    With columns, maxima and sums over a few digits are taken for many positions at once.
    Each digit's outputs are below 0 by their maximum.
    """
    seen = w["embed"].take(around.ravel(), axis=0).reshape(len(around), -1)
    hidden = w["in"].T @ seen.T
    hidden += w["in_b"][:, None]
    np.tanh(hidden, out=hidden)
    out = np.hstack([w["first"], w["second"]]).T @ hidden
    out = out.reshape(2, BASE, -1)
    out[0] += w["first_b"][:, None]
    out[1] += np.ascontiguousarray(w["second_b"].T).take(tokens // BASE, axis=1)
    out -= out.max(axis=1, keepdims=True)
    return seen, hidden, out


def forward(w: Weights, around: np.ndarray, tokens: np.ndarray):
    """What is seen, hidden values, log-probabilities of both digits; a row per position."""
    seen, hidden, out = _outputs(w, around, tokens)
    out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
    return seen, hidden.T, out[0].T, out[1].T


def log_likelihood(w: Weights, tokens: np.ndarray) -> float:
    """Sum over all positions of a text of the log-probability of its word given the others near it."""
    total = 0.0
    around = contexts(tokens)
    for at in range(0, len(tokens), CHUNK):
        part = tokens[at:at + CHUNK]
        _, _, out = _outputs(w, around[at:at + CHUNK], part)
        told = out[[[0], [1]], [part // BASE, part % BASE], np.arange(len(part))]
        total += float((told - np.log(np.exp(out, out=out).sum(axis=1))).sum(dtype=np.float64))
    return total


def gradients(w: Weights, around: np.ndarray, tokens: np.ndarray) -> Weights:
    """Of the mean negative log-probability."""
    seen, hidden, out = _outputs(w, around, tokens)
    n, rows, high = len(tokens), np.arange(len(tokens)), tokens // BASE
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True) * n
    places = high * n + rows
    out[0].ravel()[places] -= 1 / n
    out[1].ravel()[tokens % BASE * n + rows] -= 1 / n
    both = out.reshape(2 * BASE, n)
    last = hidden @ both.T
    d_hidden = np.hstack([w["first"], w["second"]]) @ both
    d_hidden *= 1 - hidden * hidden
    d_seen = d_hidden.T @ w["in"].T
    embed = np.bincount(PLACES.take(around.ravel(), axis=0).ravel(), d_seen.ravel(), w["embed"].size).reshape(w["embed"].shape)
    is_high = np.zeros((BASE, n), out.dtype)
    is_high.ravel()[places] = 1
    return {
        "embed": embed.astype(w["embed"].dtype), "in": seen.T @ d_hidden.T, "in_b": d_hidden.sum(1), "first": last[:, :BASE],
        "first_b": out[0].sum(1), "second": last[:, BASE:], "second_b": is_high @ out[1].T,
    }


class Adam:
    """``weights`` are views of one vector, so that a step is a few operations on all of them."""

    def __init__(self, weights: Weights, rate: float = RATE):
        self.values, self.rate, self.step = flat(weights), rate, 0
        self.weights = views(self.values)
        self.first, self.second, self.spare = (np.zeros_like(self.values) for _ in range(3))

    def learn(self, around: np.ndarray, tokens: np.ndarray) -> None:
        self.step += 1
        g, spare = flat(gradients(self.weights, around, tokens)), self.spare
        np.subtract(g, self.first, out=spare)
        spare *= 0.1
        self.first += spare
        g *= g
        g -= self.second
        g *= 0.01
        self.second += g
        np.divide(self.second, 1 - 0.99**self.step, out=g)
        np.sqrt(g, out=g)
        g += 1e-6
        np.multiply(self.first, self.rate / (1 - 0.9**self.step), out=spare)
        spare /= g
        self.values -= spare


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def views(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, like in sorted(untrained().items()):
        out[k] = values[at:at + like.size].reshape(like.shape)
        at += like.size
    return out


def shaped(values: np.ndarray) -> Weights:
    return views(values.astype(np.float32))


def train(docs: DataFrame, words: list[str], rounds: int = ROUNDS, stride: int = STRIDE) -> Weights:
    """Weights after ``rounds`` of local training and averaging over all texts.

    With a ``stride`` above 1 a task trains on every ``stride``-th of its positions, counted
    on from text to text, so that beginnings, ends and short texts have their share.
    """
    return learned(tokenised(numbered(docs), words), rounds, stride)


def learned(lines: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> Weights:
    """``train`` on ``tokens`` rows."""
    weights = untrained()
    for turn in range(rounds):
        start = flat(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            local, positions, walked = Adam(shaped(start)), 0, 0
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0

            def learn() -> None:
                around, wanted = (np.concatenate(x) for x in zip(*held))
                for at in range(0, len(wanted), BATCH):
                    local.learn(around[at:at + BATCH], wanted[at:at + BATCH])

            for batch in batches:
                for line in _lines(batch.column("tokens")):
                    picked = np.arange((turn * stride // rounds - walked) % stride, len(line), stride)
                    walked += len(line)
                    if len(picked):
                        held.append((contexts(line)[picked], line[picked]))
                        waiting += len(picked)
                        positions += len(picked)
                    if waiting >= 32 * BATCH:
                        learn()
                        held.clear()
                        waiting = 0
            if waiting:
                learn()
            if positions:
                change = np.rint((local.values - start).astype(np.float64) * SCALE).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"place": np.arange(len(change), dtype=np.int32), "part": change * positions, "positions": np.full(len(change), positions)})

        parts = lines.select("tokens").mapInArrow(run, "place int, part long, positions long")
        exact = "decimal(38,0)"
        sums = parts.groupBy("place").agg((F.sum(F.col("part").cast(exact)).cast("double") / F.sum("positions")).alias("change")).toPandas()
        if len(sums):
            change = np.zeros(len(start))
            change[sums["place"]] = sums["change"] / SCALE
            weights = shaped(start + change)
    return weights


def scored(docs: DataFrame, words: list[str], weights: Weights, counts: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood`` of every document.

    ``counts`` has ``word, count`` rows of the corpus; by default those of ``docs``.
    """
    counts = saved(word_counts(docs), "words") if counts is None else counts
    rows = numbered(docs)
    return _scored(rows, tokenised(rows, words), words, weights, counts)


def _scored(rows: DataFrame, lines: DataFrame, words: list[str], weights: Weights, counts: DataFrame) -> DataFrame:
    wholes = np.log(shared_counts(counts, words) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = _lines(batch.column("tokens"))
            sums = np.array([log_likelihood(weights, line) - wholes[line[line >= OWN] - OWN].sum() for line in lines], float)
            sizes = np.array([len(line) for line in lines], np.int64)
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_tokens": sizes, "sum": sums})

    told = lines.mapInArrow(run, "row long, doc_id long, n_tokens long, sum double")
    # A word that shares its token is not among the OWN most frequent, so no key is hot. The
    # log of a count of one is 0; logs are whole numbers, whose sum has no order.
    rare = rows.select("row", F.explode(F.split("text", SPACE)).alias("word")).where((F.col("word") != "") & ~F.col("word").isin(words))
    logs = counts.where("count > 1").select(F.col("word").alias("_word"), F.round(F.log("count") * LOG_SCALE).cast("long").alias("log")).hint("shuffle_hash")
    shares = rare.join(logs, F.col("word") == F.col("_word")).groupBy(F.col("row").alias("_row")).agg(F.sum("log").alias("log"))
    total = F.col("sum") + F.coalesce(F.col("log"), F.lit(0)) / LOG_SCALE
    return told.join(shares, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "n_tokens", total.alias("log_likelihood"), (total / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood"),
    )


def op2_masked_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by a network trained on all of them."""
    docs = read(spark, folder, "documents")
    counts = saved(word_counts(docs), "words")
    words = vocabulary(docs, counts)
    rows = numbered(docs)
    lines = tokenised(rows, words)
    return _scored(rows, lines, words, learned(lines), counts)


QUERIES = {"op2_masked_likelihood": op2_masked_likelihood}
SQL: dict = {}
