"""Plot-ready tables: box summaries, jittered strip points, volcano and heat map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import minus_log10, missing_to_null
from ..plans import Ordered, lookup, row_count, staged
from .matrices import row_zscores
from .summaries import significance_calls, with_palette

# --- fixed values: quartiles, whisker reach, and the width of a jitter band ---
QUARTILES = (0.25, 0.5, 0.75)
WHISKER_REACH = 1.5
JITTER = 0.1
DODGE_WIDTH = 0.8
# ------------------------------------------------------------------------------


def quantiles(df: DataFrame, group: str, value: str, probabilities: Sequence[float] = QUARTILES, *, accuracy: int = 10_000) -> DataFrame:
    """Exact linearly interpolated quantiles per group: ``n``, ``q0``, ``q1``, ...

    A first pass sketches a narrow bracket around each quantile. A second pass
    counts the rows below each bracket and the distinct values inside it, which
    is all that is shuffled. A running count over those finds the two neighbours
    of each quantile. Groups that a bracket should miss are counted in full.
    """
    rows = _present(df, group, value)
    margin = 4.0 / accuracy
    ends = [p for q in probabilities for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in ends]), F.lit(accuracy))
    brackets = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"), sketch.alias("_ends"))
    open_ended = [(q - margin <= 0, q + margin >= 1) for q in probabilities]
    columns = []
    for i, (no_low, no_high) in enumerate(open_ended):
        columns.append((F.lit(float("-inf")) if no_low else F.col("_ends")[2 * i]).alias(f"_low{i}"))
        columns.append((F.lit(float("inf")) if no_high else F.col("_ends")[2 * i + 1]).alias(f"_high{i}"))
    brackets = staged(brackets.select(group, "_size", *columns))
    sizes = brackets.select(group, "_size")
    found = staged(_neighbours(_bracketed(rows, brackets, group, len(probabilities)), sizes, group, probabilities))
    missed = staged(found.filter(F.size("_picks") < 2 * len(probabilities)).select(group, "_size"))
    if row_count(missed):
        kept = found.filter(F.size("_picks") == 2 * len(probabilities))
        again = lookup(rows, missed, [group], "inner", rename={}, weight="_size")
        whole = again.select(group, F.posexplode(F.array(*[F.col("_v")] * len(probabilities))).alias("_q", "_v"))
        counts = whole.groupBy(group, "_q", "_v").agg(F.count(F.lit(1)).alias("_n"))
        found = kept.unionByName(_neighbours(counts, missed, group, probabilities))
    results = []
    for i, q in enumerate(probabilities):
        at = (F.col("_size") - 1) * F.lit(float(q))
        low, high = F.col("_picks")[2 * i], F.col("_picks")[2 * i + 1]
        results.append((low + (high - low) * (at - F.floor(at))).alias(f"q{i}"))
    return found.select(group, F.col("_size").alias("n"), *results)


def _present(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.select(group, missing_to_null(F.col(value).cast("double")).alias("_v")).filter("_v is not null")


def _bracketed(rows: DataFrame, brackets: DataFrame, group: str, n: int) -> DataFrame:
    """Counts per (group, quantile, value inside the bracket); null for all values below."""
    keep = {c: c for c in brackets.columns if c not in (group, "_size")} | {"_size": "_size"}
    joined = lookup(rows, brackets, [group], "inner", rename=keep, weight="_size")
    entries = []
    for i in range(n):
        seat = F.when(F.col("_v") <= F.col(f"_high{i}"), F.lit(i))
        inside = F.when(F.col("_v") >= F.col(f"_low{i}"), F.col("_v"))
        entries.append(F.struct(seat.alias("_q"), inside.alias("_v")))
    spread = joined.select(group, F.explode(F.array(*entries)).alias("_e")).filter("_e._q is not null")
    return spread.groupBy(group, F.col("_e._q").alias("_q"), F.col("_e._v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def _neighbours(counts: DataFrame, sizes: DataFrame, group: str, probabilities: Sequence[float]) -> DataFrame:
    """``_picks``: the values at the floor and ceiling position of each quantile, in order."""
    running = Ordered(counts, [F.col("_v").asc_nulls_first()], [group, "_q"]).total("_n", "_upto").result()
    placed = lookup(running, sizes, [group], "inner").filter("_v is not null")
    q = F.element_at(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("_q") + 1)
    at = (F.col("_size") - 1) * q
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    seats = F.array(
        *[F.when(seat.between(first, last), F.struct((2 * F.col("_q") + side).alias("s"), F.col("_v").alias("v"))) for side, seat in enumerate((F.floor(at), F.ceil(at)))]
    )
    picked = placed.select(group, "_size", F.explode(seats).alias("_s")).filter("_s is not null")
    # At most two values per quantile and group.
    ordered = F.transform(F.sort_array(F.collect_list("_s")), lambda s: s["v"])
    found = picked.groupBy(group, "_size").agg(ordered.alias("_picks"))
    return lookup(sizes, found, [group], rename={"_picks": "_picks"}, unique=True).withColumn("_picks", F.coalesce("_picks", F.array().cast("array<double>")))


def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whisker ends and outlier count per group; ``n`` is 0 where no value is present."""
    rows = _present(df, group, value)
    quartiles = staged(quantiles(df, group, value))
    named = {"n": "n", "q0": "q1", "q1": "median", "q2": "q3"}
    reach = (F.col("q3") - F.col("q1")) * WHISKER_REACH
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    boxes = (
        lookup(rows, quartiles, [group], "inner", rename=named, weight="n")
        .groupBy(group, *named.values())
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )
    empty = df.groupBy(group).agg(F.count(missing_to_null(F.col(value).cast("double"))).alias("_n")).filter("_n = 0").select(group)
    nothing = [F.lit(None).cast("double").alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")]
    zero = F.lit(0).cast("bigint")
    return boxes.unionByName(empty.select(group, zero.alias("n"), *nothing, zero.alias("n_outliers")))


def strip_points(df: DataFrame, key: str, x: str, hue: str, x_levels: Sequence[str], hue_levels: Sequence[str], *, seed: str = "0") -> DataFrame:
    """Add ``x_position`` per row: category slot, dodged by hue, with a jitter.

    The jitter comes from a hash of the row key and the seed. It is the same in
    every run and under every partitioning.
    """
    digest = F.sha2(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(seed)), 256)
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    slot = F.array_position(F.array(*[F.lit(v) for v in x_levels]), F.col(x)) - 1
    hue_slot = F.array_position(F.array(*[F.lit(v) for v in hue_levels]), F.col(hue)) - 1
    step = DODGE_WIDTH / len(hue_levels)
    dodge = (hue_slot - F.lit((len(hue_levels) - 1) / 2)) * F.lit(step)
    jitter = (unit * 2 - 1) * F.lit(JITTER / len(hue_levels) * 2)
    return df.withColumn("x_position", slot + dodge + jitter)


def volcano_points(results: DataFrame, *, p: str = "p_value", adjusted: str = "adj_p_value", effect: str = "log_fc") -> DataFrame:
    """Coordinates and significance label of each feature."""
    return significance_calls(results, adjusted, effect).withColumn("minus_log10_p", minus_log10(F.col(p)))


def heatmap_cells(long: DataFrame, feature: str, value: str, group: str, palette: dict[str, str]) -> DataFrame:
    """Row z-score and group colour of every heat-map cell."""
    return with_palette(row_zscores(long, feature, value), group, palette)


@dataclass(frozen=True)
class PlotSource:
    """What a figure shows: the rows it is drawn from and the marks drawn from them.

    ``kind`` is ``box`` (needs ``x`` and ``value``), ``strip`` (``key``, ``x``, ``hue``,
    ``value`` and the levels of ``x`` and ``hue``) or ``heatmap`` (``x`` as feature, ``key``
    as sample, ``value``, ``hue`` as group and a ``palette``).
    """

    kind: str
    x: str
    value: str
    key: str | None = None
    hue: str | None = None
    x_levels: Sequence[str] = ()
    hue_levels: Sequence[str] = ()
    palette: dict[str, str] | None = None

    def __post_init__(self):
        needs = {"box": (), "strip": ("key", "hue", "x_levels", "hue_levels"), "heatmap": ("key", "hue", "palette")}
        if self.kind not in needs:
            raise ValueError(f"unknown kind of plot {self.kind!r}; use one of {', '.join(needs)}")
        absent = [name for name in needs[self.kind] if not getattr(self, name)]
        if absent:
            raise ValueError(f"a {self.kind} plot needs {', '.join(absent)}")

    def rows(self, df: DataFrame) -> DataFrame:
        """The columns that the figure shows, of every row."""
        return df.select(*dict.fromkeys(c for c in (self.key, self.x, self.hue, self.value) if c))

    def marks(self, rows: DataFrame) -> DataFrame:
        """One row for each thing drawn: a box, a point or a cell."""
        if self.kind == "box":
            return box_summary(rows, self.x, self.value)
        if self.kind == "strip":
            return strip_points(rows, self.key, self.x, self.hue, self.x_levels, self.hue_levels)
        return heatmap_cells(rows, self.x, self.value, self.hue, self.palette)


def plot_source(df: DataFrame, spec: PlotSource) -> tuple[DataFrame, DataFrame]:
    """Rows and marks of a figure. The input is read once: marks are drawn from the written rows."""
    rows = staged(spec.rows(df))
    return rows, spec.marks(rows)
