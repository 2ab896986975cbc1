"""Rows of a large matrix: nearest neighbours, and an order that puts like rows together.

``position_distances`` compares the columns of a matrix. Its rows are too many to compare
all with all, so neighbours come from an index and the order from splitting.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import lookup, row_count, row_numbers, staged

# Rows that the index parameters are chosen by; all rows are indexed.
SAMPLE = 2_000
# Rows of a block, queries that meet one at a time, and pairs whose exact distances are taken at once.
BLOCK, SLICE, PAIRS = 4_096, 256, 1 << 16
_PACKED = ("block", "ids", "x", "keys", "holes")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class Buckets:
    """Random projections cut into buckets: in each of ``tables``, a row has ``bits`` places.

    A place is floor((a . x + b) / width) with normal ``a``; rows share it the more likely
    the nearer they are (Datar et al. 2004).
    """

    dimensions: int
    width: float
    bits: int
    tables: int
    seed: int = 0

    @staticmethod
    def same_place(width: float, distance: float) -> float:
        """Chance that two rows at ``distance`` share one place."""
        if distance <= 0:
            return 1.0
        r = width / distance
        normal = 0.5 * math.erfc(r / math.sqrt(2))
        return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    def found(self, distance: float) -> float:
        """Chance that rows at ``distance`` meet in some table."""
        return 1 - (1 - self.same_place(self.width, distance) ** self.bits) ** self.tables

    @classmethod
    def fitted(cls, df: DataFrame, values: str, neighbours: int, recall: float, *, seed: int = 0, tables: int = 24) -> "Buckets":
        """The most selective buckets that find the ``neighbours``-th nearest row with ``recall``.

        Distances are judged on ``SAMPLE`` rows at most, ranked by a hash of their values. The
        k-th nearest of all rows is nearer than that of the sample, so the distance in the
        sample is a safe one.
        """
        some = df.select(F.col(values).cast("array<double>").alias("v")).filter("v is not null").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
        usual = Counter(len(r[0]) for r in some).most_common(1)[0][0] if some else 1
        x = np.array([r[0] for r in some if len(r[0]) == usual], dtype=float).reshape(-1, usual)
        squares = (x * x).sum(1)
        apart = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * x @ x.T, 0.0))
        nearest = np.sort(apart, axis=1)[:, min(neighbours, len(x) - 1)] if len(x) > 1 else np.ones(1)
        typical = float(np.median(apart[~np.eye(len(x), dtype=bool)])) if len(x) > 1 else 1.0
        far = float(np.quantile(nearest, 0.9)) or 1.0
        best = None
        for bits in range(1, 17):
            low, high = far * 0.05, far * 200.0
            for _ in range(60):
                middle = math.sqrt(low * high)
                low, high = (low, middle) if cls(x.shape[1], middle, bits, tables, seed).found(far) >= recall else (middle, high)
            candidate = cls(x.shape[1], high, bits, tables, seed)
            cost = candidate.found(typical)
            if best is None or cost < best[0]:
                best = (cost, candidate)
        return best[1]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The bucket of every row of ``x`` in every table, as one number."""
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(size=(self.dimensions, self.tables * self.bits))
        offsets = rng.uniform(0, self.width, self.tables * self.bits)
        # Odd multipliers make one number of the places of a table.
        mix = rng.integers(1, 1 << 62, self.bits) * 2 + 1
        with np.errstate(over="ignore", invalid="ignore"):
            places = np.floor((x @ directions + offsets) / self.width).astype(np.int64)
            return (places.reshape(len(x), self.tables, self.bits) * mix).sum(axis=2)


def nearest_rows(df: DataFrame, row: str, values: str, queries: Column, *, neighbours: int = 10, recall: float = 0.97, index: Buckets | None = None) -> DataFrame:
    """``row, near, distance, rank``: the nearest other rows of those that ``queries`` picks.

    Candidates share a bucket in some table and are compared exactly. Every row is in the
    index; ``recall`` is the chance of meeting a neighbour for which it is fitted.
    Rows without a vector, and of another width than most, have no neighbours.

    Where vectors have no clusters, most pairs share a bucket, so no pair is ever written:
    blocks of queries meet blocks of rows, and a task keeps the nearest of each query.
    """
    vectors = df.select(F.col(row).alias("_row"), F.col(values).cast("array<double>").alias("_v"), queries.alias("_asks")).filter("_v is not null")
    if index is None:
        index = Buckets.fitted(vectors, "_v", neighbours, recall)
    vectors = staged(vectors.filter((F.size("_v") == index.dimensions) & F.col("_row").isNotNull()))
    asked = staged(vectors.filter("_asks"))
    blocks, asking = _packed(vectors, index, ""), _packed(asked, index, "q")
    kind = vectors.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Nearest] = {}
        for batch in batches:
            for i in range(len(batch)):
                block = batch.column("qblock")[i].as_py()
                if block not in found:
                    found[block] = _Nearest(_Block(batch, i, "q", index), neighbours)
                found[block].meet(_Block(batch, i, "", index))
        for nearest in found.values():
            yield from nearest.rows()

    compared = blocks.crossJoin(asking).mapInArrow(run, f"_query {kind}, _row {kind}, distance double")
    nearest = Window.partitionBy("_query").orderBy("distance", "_row")
    ranked = compared.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= neighbours)
    return ranked.select(F.col("_query").alias(row), F.col("_row").alias("near"), "distance", "rank")


def _packed(vectors: DataFrame, index: Buckets, prefix: str) -> DataFrame:
    """The rows of a staged table as blocks of at most ``BLOCK``: ids, numbers and buckets; staged."""
    kind = vectors.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                some = batch.slice(start, BLOCK)
                numbers = some.column("_v").flatten()
                x = numbers.to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1)
                holes = numbers.is_null().to_numpy(zero_copy_only=False).reshape(x.shape).any(axis=1)
                ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column("_row"))
                binary = [pa.array([v.tobytes()], pa.binary()) for v in (x, index.keys(x), holes)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *binary], names=[f"{prefix}{c}" for c in _PACKED])
                number += 1

    tasks = min(vectors.sparkSession.sparkContext.defaultParallelism * 3, -(-row_count(vectors) // BLOCK))
    kinds = ("bigint", f"array<{kind}>", "binary", "binary", "binary")
    schema = ", ".join(f"{prefix}{c} {t}" for c, t in zip(_PACKED, kinds))
    return staged(vectors.select("_row", "_v").repartition(max(1, tasks)).mapInArrow(run, schema))


class _Block:
    """A block of rows, unpacked."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str, index: Buckets):
        def unpacked(column: str, kind) -> np.ndarray:
            return np.frombuffer(batch.column(f"{prefix}{column}")[i].as_py(), kind)

        ids = batch.column(f"{prefix}ids")[i].values
        self.kind = ids.type
        self.ids = ids.to_numpy() if pa.types.is_integer(ids.type) else np.array([*ids.to_pylist(), None], object)[:-1]
        self.x = unpacked("x", float).reshape(len(self.ids), index.dimensions)
        self.keys = unpacked("keys", np.int64).reshape(len(self.ids), index.tables)
        self.holes = unpacked("holes", bool)
        self.squares = (self.x * self.x).sum(axis=1)


class _Nearest:
    """The nearest rows so far of each query of a block; a distance that is null is -1 here."""

    def __init__(self, queries: _Block, neighbours: int):
        self.queries, self.neighbours = queries, neighbours
        self.query, self.near, self.distance = np.empty(0, np.int64), queries.ids[:0], np.empty(0)
        self.limit = np.full(len(queries.ids), np.inf)

    def meet(self, rows: _Block) -> None:
        found = [(self.query, self.near, self.distance)]
        for start in range(0, len(self.queries.ids), SLICE):
            found += self._compared(slice(start, start + SLICE), rows)
        query, near, distance = (np.concatenate(parts) for parts in zip(*found))
        order = np.lexsort((np.unique(near, return_inverse=True)[1], distance, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.neighbours]
        self.near, self.distance = near[kept], distance[kept]
        self.query = query[place < self.neighbours]
        last = query[place == self.neighbours - 1]
        farthest = distance[order[place == self.neighbours - 1]]
        self.limit[last] = np.where(np.isnan(farthest), np.inf, np.square(farthest))

    def _compared(self, part: slice, rows: _Block) -> Iterator[tuple]:
        """Query, id and exact distance of pairs that share a bucket, but for those that are surely too far."""
        asks, limit = self.queries, self.limit[part]
        with np.errstate(invalid="ignore", over="ignore"):
            both = asks.squares[part, None] + rows.squares[None]
            about = both - 2 * (asks.x[part] @ rows.x.T)
            # More than rounding can be.
            slack = np.finfo(float).eps * 8 * (asks.x.shape[1] + 8) * both
            if np.isinf(limit).any() and len(rows.ids) > self.neighbours:
                met = asks.ids[part, None] != rows.ids[None]
                met &= np.logical_or.reduce([asks.keys[part, t, None] == rows.keys[None, :, t] for t in range(rows.keys.shape[1])])
                upper = np.where(met & np.isfinite(about), about + slack, np.inf)
                limit = np.minimum(limit, np.partition(upper, self.neighbours - 1, axis=1)[:, self.neighbours - 1])
            query, near = np.nonzero(~(about - slack > limit[:, None] * (1 + 1e-12)))
            query = query + part.start
            for start in range(0, len(query), PAIRS):
                q, r = query[start:start + PAIRS], near[start:start + PAIRS]
                met = (asks.ids[q] != rows.ids[r]).astype(bool) & (asks.keys[q] == rows.keys[r]).any(axis=1)
                q, r = q[met], r[met]
                # One after the other, as an aggregate over the array adds.
                distance = np.sqrt(np.cumsum(np.square(asks.x[q] - rows.x[r]), axis=1)[:, -1]) if asks.x.shape[1] else np.zeros(len(q))
                yield q, rows.ids[r], np.where(asks.holes[q] | rows.holes[r], -1.0, distance)

    def rows(self) -> Iterator[pa.RecordBatch]:
        ids = [pa.array(v.tolist(), self.queries.kind) for v in (self.queries.ids[self.query], self.near)]
        distance = pa.array(self.distance, pa.float64(), mask=self.distance < 0)
        yield pa.RecordBatch.from_arrays([*ids, distance], names=["_query", "_row", "distance"])


def row_order(df: DataFrame, row: str, values: str, *, leaf: int = 32, rounds: int = 2, seed: int = 0) -> DataFrame:
    """``row, position``: rows numbered 1, 2, ... so that like rows are near each other.

    Bisecting k-means: every part above ``leaf`` rows is split between two centres. These
    begin as its outermost rows along a random direction and move to the means of their
    rows ``rounds`` times; all parts of a level are split together, by aggregates per
    part. In a part, rows are ordered by their place between its centres. Rows without a
    vector come first.
    """
    rows = df.select(F.col(row).alias("_row"), F.col(values).cast("array<double>").alias("_v"))
    rows = staged(rows.withColumns({"_part": F.lit(""), "_along": F.lit(0.0), "_done": F.col("_v").isNull()}))
    width = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    rng = np.random.default_rng(seed)
    while True:
        sizes = rows.filter("not _done").groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        parts = staged(sizes.filter(F.col("_n") > leaf))
        if not row_count(parts):
            break
        rows = staged(_split(rows, parts, rounds, rng.normal(size=width).tolist()))
    return row_numbers(rows, [F.col("_part"), F.col("_along"), F.col("_row")], "position").select(F.col("_row").alias(row), "position")


def _split(rows: DataFrame, parts: DataFrame, rounds: int, direction: list[float]) -> DataFrame:
    active = lookup(rows.filter("not _done"), parts, ["_part"], "inner", rename={}, weight="_n")
    along = F.aggregate(F.zip_with("_v", F.array(*[F.lit(x) for x in direction]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ends = active.withColumn("_d", along).groupBy("_part")
    centres = staged(ends.agg(F.min_by("_v", "_d").alias("_a"), F.max_by("_v", "_d").alias("_b"), (F.max("_d") - F.min("_d")).alias("_most")))
    for _ in range(rounds):
        nearer = lookup(active, centres, ["_part"]).withColumn("_side", _beyond() > 0)
        means = nearer.select("_part", "_side", F.posexplode("_v").alias("_j", "_x")).groupBy("_part", "_side", "_j").agg(F.avg("_x").alias("_x"))
        # As many values as a row has.
        ordered = means.groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("_side", "_j", "_x"))).alias("_c"))

        def centre(side: bool, old: str) -> Column:
            own = F.transform(F.filter("_c", lambda p: p["_side"] == F.lit(side)), lambda p: p["_x"])
            return F.when(F.size(own) > 0, own).otherwise(F.col(old)).alias(old)

        centres = staged(lookup(centres, ordered, ["_part"], unique=True).select("_part", centre(False, "_a"), centre(True, "_b"), "_most"))
    # Rows that are all equal cannot be split.
    placed = lookup(rows, centres, ["_part"])
    split = F.col("_a").isNotNull() & ~F.col("_done")
    half = F.when(split & (F.col("_most") > 0), F.concat("_part", F.when(_beyond() > 0, "1").otherwise("0"))).otherwise(F.col("_part"))
    return placed.select(
        "_row", "_v", half.alias("_part"), F.when(split, _beyond()).otherwise(F.col("_along")).alias("_along"),
        F.coalesce(F.col("_done") | (split & (F.col("_most") == 0)), F.lit(False)).alias("_done"),
    )


def _beyond() -> Column:
    """How much nearer a row is to the second centre of its part than to the first."""
    return squared_distance(F.col("_v"), F.col("_a")) - squared_distance(F.col("_v"), F.col("_b"))
