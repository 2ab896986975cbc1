"""Attach a unique-key table to rows without trusting its size or the key spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .staging import staged

# A lookup table is broadcast only below both limits, measured while staging it.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# A key is hot when it holds more than 1/HOT_SHARE of all rows, hence there are
# at most HOT_SHARE hot keys and their list can always be broadcast.
HOT_SHARE = 1_000


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    rename: dict[str, str] | None = None,
    flag: str | None = None,
    weight: str | None = None,
    unique: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``table`` (one row per key, null is a key) to ``rows``.

    The table is staged and measured first (unless ``bounded_by`` tells its limits).
    Up to ``broadcast_rows`` and ``BROADCAST_BYTES`` it is broadcast and ``rows`` is
    not shuffled at all. Beyond that both sides are shuffled on the key, with every
    hot key of ``rows`` split over many tasks.

    ``rename`` picks and renames the attached columns (all, unchanged); ``flag``
    adds a column that is true where a key was found. ``weight`` names a table
    column that already holds the rows per key, which saves counting them.
    ``unique`` says that ``rows`` has no hot keys either.
    """
    on = list(on)
    small = getattr(table, "_rows_limit", broadcast_rows + 1) <= broadcast_rows and table._bytes_limit <= BROADCAST_BYTES
    if not small:
        table = staged(table)
        small = table._rows <= broadcast_rows and table._bytes <= BROADCAST_BYTES
    rename = {c: c for c in table.columns if c not in on} if rename is None else rename
    columns = [F.col(_q(old)).alias(new) for old, new in rename.items()]
    columns += [F.lit(True).alias(flag)] if flag else []
    attached = table.select(*[F.col(_q(c)) for c in on], *columns)
    if small:
        return _null_safe_join(rows, F.broadcast(attached), on, how)
    if unique:
        return _null_safe_join(rows, attached, on, how)
    keys = [F.col(_q(c)) for c in on]
    if weight is not None:
        counts = table.select(*keys, F.col(_q(weight)).alias("_rows"))
    else:
        counts = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    return _salted_join(rows, attached, counts, on, how)


def _null_safe_join(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    renamed = table.select(
        *[F.col(_q(c)).alias(f"_key_{c}") for c in on],
        *[F.col(_q(c)) for c in table.columns if c not in on],
    )
    condition: Column = F.lit(True)
    for c in on:
        condition = condition & rows[_q(c)].eqNullSafe(renamed[_q(f"_key_{c}")])
    joined = rows.join(renamed, condition, how)
    return joined.drop(*[f"_key_{c}" for c in on]) if how not in ("left_semi", "left_anti") else joined


def _salted_join(rows: DataFrame, table: DataFrame, counts: DataFrame, on: list[str], how: str) -> DataFrame:
    """Shuffle join in which hot keys of ``rows`` are spread over salts."""
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    share = max(1, total // HOT_SHARE)
    hot = counts.filter(F.col("_rows") > share).select(
        *[F.col(_q(c)) for c in on], F.ceil(F.col("_rows") / F.lit(share)).cast("int").alias("_salts")
    )
    # At most HOT_SHARE rows by construction.
    salted_rows = _null_safe_join(rows, F.broadcast(hot), on, "left").withColumn(
        "_salt", F.pmod(_row_hash(rows), F.coalesce("_salts", F.lit(1))).cast("int")
    ).drop("_salts")
    salted_table = _null_safe_join(table, F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return _null_safe_join(salted_rows, salted_table, [*on, "_salt"], how).drop("_salt")


def _row_hash(rows: DataFrame) -> Column:
    """A hash of the row itself: a task that runs again deals its rows out as before."""
    hashable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(_q(c)) for c in hashable])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
