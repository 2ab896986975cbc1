"""Registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, exchanges, matrices, projects, publishing, relational, statistics
from .registry import REGISTRY

__all__ = ["audits", "exchanges", "matrices", "oracle_sql", "projects", "publishing", "queries", "relational", "statistics"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}
