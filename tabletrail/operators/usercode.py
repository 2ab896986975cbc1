"""User code over groups of any size: partial states, merged in a tree, joined back.

The user gives three functions over plain values: one makes a state (bytes) from some
rows of a group, one merges two states, one turns the state of a whole group into a
row. No task ever holds more than a batch of rows and two states of a group, so a group with
a third of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans import lookup
from .exchange import check_exchangeable, to_exchange

# States of this many groups are merged in a task before they are handed on.
GROUPS_HELD = 10_000
# A group reaches the last step as at most this many states, however many tasks held it.
FAN_IN = 64


def reduce_groups(
    df: DataFrame, by: list[str], partial: Callable[[pd.DataFrame], bytes], merge: Callable[[bytes, bytes], bytes],
    finish: Callable[[bytes], tuple], schema: str,
) -> DataFrame:
    """One row per group: the keys, then the columns of ``schema`` from ``finish``.

    ``merge`` has to be associative and commutative, as states meet in any order.
    """
    keys = [f"`{c}`" for c in by]
    exchanged = to_exchange(df)
    fields = exchanged.select(*keys).schema.fields
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    # pandas turns whole numbers into floats where some are missing.
    whole = [isinstance(f.dataType, T.IntegerType) for f in fields]
    names = [field.strip().split()[0].strip("`") for field in schema.split(", ")]

    def plain(key: tuple) -> tuple:
        return tuple(None if pd.isna(k) else int(k) if w else k for k, w in zip(key, whole))

    def tables(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
        while some := list(islice(rows, 1000)):
            yield pd.DataFrame(some, columns=columns, dtype=object)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, bytes] = {}
        for batch in batches:
            for key, rows in batch.groupby(by, dropna=False, sort=False):
                key = plain(key if isinstance(key, tuple) else (key,))
                state = partial(rows.reset_index(drop=True))
                states[key] = merge(states[key], state) if key in states else state
            if len(states) >= GROUPS_HELD:
                yield from tables(((*k, s) for k, s in states.items()), [*by, "_state"])
                states = {}
        yield from tables(((*k, s) for k, s in states.items()), [*by, "_state"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bytes]]:
        """Key and state of each group of rows that are sorted by key."""
        held, state = None, None
        for batch in batches:
            for *key, more in batch[[*by, "_state"]].itertuples(index=False, name=None):
                key = plain(key)
                if held == key:
                    state = merge(state, bytes(more))
                else:
                    if held is not None:
                        yield held, state
                    held, state = key, bytes(more)
        if held is not None:
            yield held, state

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from tables(((*key, state) for key, state in merged(batches)), [*by, "_state"])

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from tables(((*key, *finish(state)) for key, state in merged(batches)), [*by, *names])

    states = exchanged.mapInPandas(begin, f"{key_fields}, _state binary")
    seat = F.pmod(F.xxhash64("_state"), F.lit(FAN_IN))
    fewer = states.withColumn("_seat", seat).repartition(*keys, "_seat").sortWithinPartitions(*keys).mapInPandas(between, f"{key_fields}, _state binary")
    result = fewer.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(end, f"{key_fields}, {schema}")
    check_exchangeable(result.schema)
    return result


def with_group_results(
    df: DataFrame, by: list[str], partial: Callable[[pd.DataFrame], bytes], merge: Callable[[bytes, bytes], bytes],
    finish: Callable[[bytes], tuple], schema: str,
) -> DataFrame:
    """Every row of ``df`` with its group's result."""
    return lookup(df, reduce_groups(df, by, partial, merge, finish, schema), by)
