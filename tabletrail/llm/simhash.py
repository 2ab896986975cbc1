"""SimHash near-duplicates by pivot distance tables.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits.

1. Only distinct fingerprints are compared; copies share one.
2. They are dealt over tables keyed by some of ``RUNS`` runs of bits: all but ``radius``
   of the runs are equal in any linked pair, so every pair meets under the key of
   those runs, while few unrelated fingerprints share a key.
3. In a group, distances to reference fingerprints are computed once per member. A
   pair is discarded if any of these coordinates differ by more than ``radius`` (the
   triangle inequality) and otherwise verified bit by bit. The search walks from
   linked members to members not yet reached, so it returns a spanning tree: no link
   between components is lost, and no clique is written out.
4. A group above ``ROOM`` members is cut into blocks and every pair of blocks is a group.
5. Components of the trees are found by alternating star contractions.

Edge cases: a null or empty text has fingerprint zero and links like any other;
repeated rows and equal ids each get a row; a null id takes part but is never a
component id unless all ids of its component are null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import measured, read, saved

RADIUS = 4
ROOM = 8192
PIVOTS = 24
RUNS = 6  # 15 tables with keys of about 21 bits; 7 gives 35 tables and 27 bits, for billions of fingerprints


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed integer) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest, ones = xxhash.xxh64_intdigest, np.arange(64)
        for batch in batches:
            prints = np.zeros(len(batch), np.uint64)
            for row, text in enumerate(batch["text"]):
                # bytes: split() and lower() then know ASCII only, as the rule says.
                words = (text or "").encode().lower().split()
                if not words:
                    continue
                votes, count = np.zeros(64, np.int64), max(len(words) - 3, 1)
                for at in range(0, count, 1 << 16):
                    part = words[at:at + (1 << 16) + 3]
                    line = b" ".join(part)
                    ends = np.cumsum([len(w) + 1 for w in part])
                    starts = (np.concatenate(([0], ends[:-1])))[: max(len(part) - 3, 1)].tolist()
                    stops = (ends[min(3, len(part) - 1):] - 1).tolist()
                    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], "<u8")
                    votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                prints[row] = np.bitwise_or.reduce(np.uint64(1) << ones[2 * votes > count].astype(np.uint64), initial=np.uint64(0))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": prints.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def _tables(prints: DataFrame, radius: int, runs: int) -> DataFrame:
    """``tab, key, fp``: each fingerprint once per choice of the runs that must be equal."""
    edges = [round(64 * i / runs) for i in range(runs + 1)]
    masks = [sum((1 << b) - (1 << a) for a, b in (edges[i:i + 2] for i in kept)) for kept in combinations(range(runs), runs - radius)]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for i, x in enumerate(signed)]))
    return prints.select("fp", keyed.alias("k")).select("k.tab", "k.key", "fp")


def spanning(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct fingerprints, as positions."""
    n = len(fps)
    step = max(n // PIVOTS, 1)
    table = np.bitwise_count(fps[:, None] ^ fps[::step][None, :PIVOTS]).astype(np.int8)
    left, a, b = np.arange(n), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = left
            for coordinate in range(table.shape[1]):
                near = near[np.abs(table[near, coordinate] - table[x, coordinate]) <= radius]
                if len(near) < 32:
                    break
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
            if len(near):
                a += [int(x)] * len(near)
                b += near.tolist()
                front += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return a, b


def links(prints: DataFrame, radius: int = RADIUS, room: int = ROOM, runs: int = RUNS) -> DataFrame:
    """``a, b``: links that join the same fingerprints as all links do. ``prints`` has distinct ``fp``."""
    rows = _tables(prints, radius, runs)
    large = measured(rows.groupBy("tab", "key").count().where(F.col("count") > room).select(F.col("tab").alias("_tab"), F.col("key").alias("_key"), F.ceil(F.col("count") / room).cast("int").alias("cuts")))
    cut = rows.join(large, (F.col("tab") == F.col("_tab")) & (F.col("key") == F.col("_key")), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.struct(F.least(i, own).alias("lo"), F.greatest(i, own).alias("hi")))
    dealt = cut.select("tab", "key", F.explode(cells).alias("cell"), "fp")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(group["fp"].to_numpy().view(np.uint64))
        a, b = spanning(fps, radius)
        return pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    def many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Groups are short and many: each batch holds whole groups as lists.
        for batch in batches:
            found = [run(pd.DataFrame({"fp": np.asarray(fps, np.int64)})) for fps in batch["fps"]]
            yield pd.concat(found) if found else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    # A group holds two blocks at most, so its list is bounded.
    groups = dealt.groupBy("tab", "key", "cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return groups.mapInPandas(many, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``a, b``: the smallest node it is linked to, by alternating stars.

    Every round sends nodes to the smallest neighbour, first their larger neighbours,
    then the smaller ones. Rounds grow with the logarithm of the number of nodes; each
    is written to the shared folder, so lineage stays short.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("_u"), "m")
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(low, F.col("u") == F.col("_u")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        then = saved(small.where("u <> v").distinct(), "edges")
        if _same(now, then):
            return then.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = then


def _same(a: DataFrame, b: DataFrame) -> bool:
    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    return mark(a) == mark(b)


def clusters(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    rows = saved(fingerprints(docs), "prints")
    prints = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(prints.select("fp"), radius))
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    table = rooted.join(named, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id")
    return rows.join(measured(table), F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "root", "component_id")


def op10_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = clusters(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one its id names.

    Of rows that share this id, one stays. Of a component without any id, the rows'
    texts stand for ids, by their hash.
    """
    found = saved(clusters(docs), "clusters")
    lost = found.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_lost_id")).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(measured(lost), F.col("doc_id") == F.col("_lost_id"), "left_anti")
    # Few or none in a table with a key: ids held by several rows.
    double = measured(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_double_id")))
    once = named.join(double, F.col("doc_id") == F.col("_double_id"), "left_anti")
    again = named.join(double, F.col("doc_id") == F.col("_double_id"), "left_semi").dropDuplicates(["doc_id"])
    kept = once.unionByName(again)
    if found.where(F.col("component_id").isNull()).limit(1).count():
        text_key = F.xxhash64(F.coalesce("text", F.lit("")))
        unnamed = docs.where(F.col("doc_id").isNull())
        roots = found.where(F.col("component_id").isNull()).select(F.col("fp").alias("_fp"), "root").distinct()
        keyed = fingerprints(unnamed.select(text_key.alias("doc_id"), "text")).join(roots, F.col("fp") == F.col("_fp"))
        first = keyed.groupBy("root").agg(F.min("doc_id").alias("_text_key")).select("_text_key")
        kept = kept.unionByName(unnamed.join(measured(first), text_key == F.col("_text_key"), "left_semi").dropDuplicates(["text"]))
    return kept


QUERIES = {"op10_simhash_components": op10_simhash_components}
SQL: dict = {}
