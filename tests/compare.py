"""Compare a Spark result with its SQL twin, row by row."""

from __future__ import annotations

import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> str | None:
    """None when equal, else a short description."""
    mine_columns, mine = _rows(df.columns, df.collect())
    cursor = connection.execute(sql)
    theirs_columns, theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if mine_columns != theirs_columns:
        return f"columns {mine_columns} != {theirs_columns}"
    if mine == theirs:
        return None
    only_mine, only_theirs = mine - theirs, theirs - mine
    return (
        f"{sum(mine.values())} vs {sum(theirs.values())} rows; {sum(only_mine.values())} only in Spark, e.g. {sorted(only_mine)[:2]}; "
        f"{sum(only_theirs.values())} only in SQL, e.g. {sorted(only_theirs)[:2]}"
    )
