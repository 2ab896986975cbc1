"""Operators on words: byte-level BPE, spelling variants, periodic runs, each against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_corpus import FOLDER, frame

from tabletrail.llm import byte_bpe, periodic, spelling

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


# 13 byte-level BPE

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed_text(rng, size):
    """Words, digits, runs of white space, quotes and characters of one to four bytes."""
    kinds = ["the", " of", "'re", "'", "''s", "  ", "\n\n ", "\t", "é", "ßte", "日本", "🙂", "123", "4567890", "!?", "<|endoftext|>", "\xa0", "x" * 40, "　 "]
    out = ""
    while len(out) < size:
        out += rng.choice(kinds) if rng.random() < 0.7 else "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(12)))
    return out[:size]


def whole_texts(tokens):
    rows = defaultdict(list)
    for r in tokens.collect():
        rows[(r.doc_id, r.row)].append((r.part, r.parts, r.ids))
    assert all([p[0] for p in sorted(v)] == list(range(v[0][1])) for v in rows.values())
    return sorted((k[0] is None, k[0] or 0, [i for p in sorted(v) for i in p[2]]) for k, v in rows.items())


def test_chunks_stitch_to_the_tokens_of_whole_texts(spark, library):
    rng = random.Random(5)
    texts = [mixed_text(rng, rng.choice([3, 90, 130, 700, 3000])) for _ in range(150)]
    texts += ["a" * 900, " " * 800 + "x", "ab " * 50 + "z" * 400 + " ab" * 60, "'" * 500, "x'r" * 200, "word " * 300]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for chunk, overlap in ((64, 40), (100, 24), (1000, 90)):
        found = whole_texts(byte_bpe.encoded(docs, RANKS, PATTERN, chunk, overlap))
        assert [f[2] for f in found] == [library.encode_ordinary(t) for t in texts]


def test_some_texts_are_stitched_and_some_torn(spark):
    docs = frame(spark, [(1, "some words " * 40, None, None), (2, "a" * 900, None, None)])
    parts = {r.doc_id: r.parts for r in byte_bpe.encoded(docs, RANKS, PATTERN, 100, 40).collect()}
    assert parts[1] > 1 and parts[2] == 1


def test_merges_equal_the_library(library):
    rng, vocab = random.Random(6), byte_bpe.Vocabulary(RANKS)
    pieces = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 60))).encode() for _ in range(3000)]
    pieces += [b"a" * n for n in (1, 2, 7, 1000)] + [bytes(rng.randrange(256) for _ in range(30)) for _ in range(300)]
    for piece in pieces:
        assert list(vocab.merged(piece)) == library._encode_single_piece(piece)


def test_decoding_gives_the_bytes_back(spark):
    rng = random.Random(7)
    texts = {i: mixed_text(rng, 500) for i in range(20)}
    tokens = byte_bpe.encoded(frame(spark, [(i, t, None, None) for i, t in texts.items()]), RANKS, PATTERN, 120, 60)
    parts = defaultdict(dict)
    for r in byte_bpe.decoded(tokens, RANKS).collect():
        parts[r.doc_id][r.part] = bytes(r.bytes)
    assert {i: b"".join(p[k] for k in sorted(p)).decode() for i, p in parts.items()} == texts


def bpe_digest(library, doc, text):
    ids = library.encode_ordinary(text or "")
    return doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = byte_bpe.op13_byte_bpe(spark, FOLDER).collect()
    assert sorted(tuple(r) for r in found) == sorted(bpe_digest(library, *d) for d in docs)


def test_bpe_of_awkward_rows(spark, library, nothing):
    rows = [(1, None), (2, ""), (None, "x y"), (None, "x y"), (None, None), (3, "word " * 500), (3, "word " * 500), (3, "other"), (4, "<|endoftext|>")]
    docs = frame(spark, [(d, t, None, None) for d, t in rows])
    alone, several = byte_bpe._encoded(docs, RANKS, PATTERN, 300, 60)
    found = byte_bpe.digests(alone, RANKS, alone=True).unionByName(byte_bpe.digests(several, RANKS)).collect()
    assert Counter(map(tuple, found)) == Counter(bpe_digest(library, *r) for r in rows)
    assert byte_bpe.encoded(nothing, RANKS, PATTERN).count() == 0


# 12 periodic runs

def brute_runs(words, least):
    """All stretches of every period, extended; of equal ones the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def strings(rng):
    """Random, Fibonacci-like, nested and noisy periodic texts over small alphabets."""
    for size in (1, 2, 3, 5, 8, 13, 21, 40, 80, 150):
        for letters in ("a", "ab", "abc", "abcdefgh"):
            yield [rng.choice(letters) for _ in range(size)]
    a, b = ["a"], ["a", "b"]
    while len(b) < 200:
        a, b = b, b + a
        yield b
    for _ in range(150):
        base = [rng.choice("ab") for _ in range(rng.randint(1, 9))]
        text = base * rng.randint(1, 9) + base[: rng.randrange(len(base) + 1)]
        text = text * rng.randint(1, 3) + [rng.choice("ab") for _ in range(rng.randrange(6))] + text
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice("abc")
        yield text
    for p in range(1, 6):  # two stretches of one period that meet out of step
        for m in range(1, 9):
            left = (["a"] + ["b"] * p) * m
            yield left + left[rng.randrange(len(left)):] + left


@pytest.mark.parametrize("least", [2, 12])
def test_all_runs_of_small_texts(least):
    texts = [[w.encode() for w in t] for t in strings(random.Random(8))]
    found = [[tuple(r) for r in runs.tolist()] for runs, _ in periodic._judged(texts, least)]
    want = [brute_runs(t, least) for t in texts]
    assert found == want and sum(map(len, want)) > 100


def test_every_binary_text_of_fifteen_words():
    texts = [[b"ab"[int(c):int(c) + 1] for c in f"{x:015b}"] for x in range(1 << 14)]
    found = [[tuple(r) for r in runs.tolist()] for runs, _ in periodic._judged(texts, 2)]
    for text, runs in zip(texts[::7], found[::7]):
        assert runs == brute_runs(text, 2)


def periodic_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = quick_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *sha)


def quick_runs(words, least=12):
    """The same as brute_runs, period by period with numpy."""
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int)
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate(([0], (ids[:-q] == ids[q:]).astype(np.int8), [0]))
        edges = np.diff(same)
        for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if e + q - s >= max(least, 2 * q):
                found.setdefault((int(s), int(e + q)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


COLUMNS_12 = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = periodic.op12_periodic_runs(spark, FOLDER)
    assert found.columns == COLUMNS_12
    want = [periodic_row(*d) for d in docs]
    assert Counter(map(tuple, found.collect())) == Counter(want) and sum(r[1] > 0 for r in want) > 10


def test_periodic_awkward_rows(spark, nothing, tmp_path):
    long = " ".join(["of the"] * 40_000)
    rows = [(None, None), (None, "a " * 30), (1, ""), (2, " \t\n"), (3, "a\u00a0b " * 20), (3, "a\u00a0b " * 20), (3, "x"), (30, "one two three four five six seven"), (1005, long)]
    rows += [(i, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 " * (i % 5)) for i in range(60)]
    frame(spark, [(d, t, None, None) for d, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic.op12_periodic_runs(spark, str(tmp_path)).collect()
    picked = [r for r in rows if r[0] != 1005]
    assert Counter(tuple(r) for r in found if r.doc_id != 1005) == Counter(periodic_row(*r) for r in picked)
    # A text of 80,000 words in one run is checked by hand.
    assert [(r.n_runs, r.start, r.length, r.period) for r in found if r.doc_id == 1005] == [(1, 0, 80_000, 2)]
    assert periodic.collapsed(nothing).count() == 0


# 11 spelling variants

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = None if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(counts):
    deleted = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            deleted[w[:i] + w[i + 1:]].add(w)
    form, rows = {}, []
    for w, n in counts.items():
        # Near words share a text with one letter less, or are one.
        some = {v for i in range(len(w)) for v in deleted[w[:i] + w[i + 1:]]} | deleted[w] | {w[:i] + w[i + 1:] for i in range(len(w))}
        others = [v for v in some if v in counts and v != w and near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        rows.append((w, n, len(others)))
    out = []
    for w, n, k in rows:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, k, counts[form[w]] if form[w] else None))
    return out


def test_spelling_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants(brute_counts(docs))
    found = spelling.op11_spelling_variants(spark, FOLDER)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, found.collect())) == Counter(want) and sum(r[1] is not None for r in want) > 10


def test_all_near_words_of_small_alphabets(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    table = spark.createDataFrame([(w, rng.randint(3, 99)) for w in words], "word string, n long")
    found = [(r.word, r.near) for r in spelling.neighbours(table).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a != b and near(a, b))


def test_chains_of_forms(spark):
    # Each word is near the next one only, which is twice as frequent.
    letters = "abcdefghijklmnop"
    words = [letters[:i].upper().lower() + "z" * (16 - i) for i in range(17)]
    table = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(words)], "word string, n long")
    found = {r.word: (r.form, r.root) for r in spelling.grouped(table).collect()}
    assert found == {w: (words[i + 1] if i < 16 else None, words[16]) for i, w in enumerate(words)}


def test_spelling_awkward_rows(spark, nothing, tmp_path):
    text = "Stra\u00dfe strase StraSSe \u00c9tude \u00e9tude x\u00d7y\u00f7z hello helo hell\u0142 hello-hullo " * 4
    rows = [(None, text), (None, None), (1, ""), (2, text), (2, text), (3, "12 !?"), (4, text * 900)] + [(i, text) for i in range(5, 60)]
    frame(spark, [(d, t, None, None) for d, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    found = spelling.op11_spelling_variants(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(brute_variants(brute_counts(rows)))
    frame(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert spelling.op11_spelling_variants(spark, f"{tmp_path}/empty").count() == 0
