"""Digests of fixed chunks of files, and a tree over them.

A whole-file hash is one sequential read by one task and says only that something
changed. Chunks of a large file are hashed by many tasks; nodes over ``FAN_OUT`` digests
each lead up to one root per file. Equal roots are equal files; where roots differ, only
differing nodes are opened on the way down to the damaged ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans import staged
from .storage import CHUNK, _arrow, _spread

CHUNK_SIZE = 8 << 20
FAN_OUT = 256


def chunk_digests(files: DataFrame, root: str, chunk: int = CHUNK_SIZE) -> DataFrame:
    """``path, chunk, start, length, sha256`` of every chunk of ``path, size``; staged.

    An empty file has one chunk of no bytes. What cannot be read has a null digest.
    """
    last = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("bigint") - 1
    start = F.col("chunk") * chunk
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    ranges = staged(ranges.select("path", "chunk", start.alias("start"), F.least(F.lit(chunk), F.col("size") - start).alias("length")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["sha256"] = [_hash_range(f"{root}/{p}", a, n) for p, a, n in zip(batch["path"], batch["start"], batch["length"])]
            yield batch

    schema = "path string, chunk bigint, start bigint, length bigint, sha256 string"
    # Few files may be many chunks: they are spread by chunk, not by path.
    return staged(_spread(ranges, "path", "chunk").mapInPandas(run, schema))


def _hash_range(uri: str, start: int, length: int) -> str | None:
    filesystem, path = _arrow(uri)
    digest = hashlib.sha256()
    try:
        with filesystem.open_input_file(path) as stream:
            stream.seek(start)
            while length > 0 and (data := stream.read(min(CHUNK, length))):
                digest.update(data)
                length -= len(data)
    except OSError:
        return None
    return digest.hexdigest() if length == 0 else None


def chunk_tree(chunks: DataFrame) -> DataFrame:
    """``path, level, node, first, sha256`` of all nodes; level 0 are the chunks, the highest one is a root.

    A node is the hash of its children's digests in order; ``first`` is its first chunk.
    """
    level = chunks.select("path", F.lit(0).alias("level"), F.col("chunk").alias("node"), F.col("chunk").alias("first"), "sha256")
    levels, number = [level], 0
    while True:
        many = level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path")
        if many.isEmpty():
            break
        number += 1
        # At most FAN_OUT children each.
        children = F.transform(F.sort_array(F.collect_list(F.struct("node", F.coalesce("sha256", F.lit("")).alias("sha256")))), lambda c: c["sha256"])
        above = level.join(many, "path", "left_semi").groupBy("path", F.expr(f"node div {FAN_OUT}").alias("_above"))
        nodes = above.agg(F.min("first").alias("first"), F.sha2(F.array_join(children, ""), 256).alias("sha256"))
        level = staged(nodes.select("path", F.lit(number).alias("level"), F.col("_above").alias("node"), "first", "sha256"))
        levels.append(level)
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionByName(more)
    return staged(tree)


def roots(tree: DataFrame) -> DataFrame:
    """``path, root``: the digest of each file's highest node."""
    top = tree.groupBy("path").agg(F.max("level").alias("level"))
    return tree.join(top, ["path", "level"]).select("path", F.col("sha256").alias("root"))


def damaged_ranges(recorded: DataFrame, tree: DataFrame, now: DataFrame, now_tree: DataFrame) -> DataFrame:
    """``path, start, length`` of each stretch of bytes whose chunks are not as recorded.

    ``recorded`` and ``now`` are chunks, with their trees. Files of equal root are not opened
    further; a level is only compared below nodes that differ. A file that is gone is
    damaged as a whole, and what one has grown by is a stretch as well.
    """
    before, after = roots(tree), roots(now_tree).withColumnRenamed("root", "_root")
    differing = before.join(after, "path", "left").filter(~F.col("root").eqNullSafe(F.col("_root"))).select("path")
    mine, theirs = (t.join(differing, "path", "left_semi") for t in (tree, now_tree))
    highest = mine.agg(F.max("level")).first()[0] or 0
    open_nodes = None
    for level in range(highest, 0, -1):
        nodes = mine.filter(F.col("level") == level)
        # A file whose tree begins at this level, or nodes below an open one.
        if open_nodes is not None:
            begins = nodes.join(mine.filter(F.col("level") > level).select("path").distinct(), "path", "left_anti")
            below = nodes.withColumn("_above", F.expr(f"node div {FAN_OUT}")).join(open_nodes.withColumnRenamed("node", "_above"), ["path", "_above"], "left_semi").drop("_above")
            nodes = begins.unionByName(below)
        same = theirs.filter(F.col("level") == level).select("path", "node", "sha256")
        open_nodes = staged(nodes.join(same, ["path", "node", "sha256"], "left_anti").select("path", "node"))
    wanted = recorded.join(differing, "path", "left_semi")
    if open_nodes is not None:
        single = wanted.join(mine.filter("level > 0").select("path").distinct(), "path", "left_anti")
        below = wanted.withColumn("_node", F.expr(f"chunk div {FAN_OUT}")).join(open_nodes.withColumnRenamed("node", "_node"), ["path", "_node"], "left_semi").drop("_node")
        wanted = single.unionByName(below)
    changed = wanted.join(now.select("path", "chunk", "length", "sha256"), ["path", "chunk", "length", "sha256"], "left_anti")
    added = now.join(differing, "path", "left_semi").join(recorded.select("path", "chunk"), ["path", "chunk"], "left_anti")
    columns = ["path", "chunk", "start", "length"]
    changed = changed.select(*columns).unionByName(added.select(*columns))
    # Chunks next to each other are one stretch; a file's chunks are few against its bytes.
    order = Window.partitionBy("path").orderBy("chunk")
    stretch = changed.withColumn("_stretch", F.col("chunk") - F.row_number().over(order))
    return stretch.groupBy("path", "_stretch").agg(F.min("start").alias("start"), F.sum("length").alias("length")).drop("_stretch")
