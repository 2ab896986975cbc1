"""Bulk checks of table, unit, file and external path names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import EXTERNAL, FLAT, UNIT, ends_in, problem_column


def name_lint(df: DataFrame, name: str, *, suffix: str = ".csv") -> DataFrame:
    """The rule each name breaks in each role; null where it is valid."""
    roles = {"table": (*FLAT, ends_in(suffix)), "file": FLAT, "unit": UNIT, "external": EXTERNAL}
    return df.withColumns({f"{role}_problem": problem_column(rules, F.col(name)) for role, rules in roles.items()})
