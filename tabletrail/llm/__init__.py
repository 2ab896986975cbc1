"""Operators of a training-data pipeline, their queries and SQL. Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("decontamination", "mixing", "secrets", "simhash", "urls", "languages", "substrings", "html_pages", "lm_scores", "search", "byte_bpe", "periodic", "spelling")


def _gathered(name: str) -> dict:
    return {k: v for module in _MODULES for k, v in getattr(import_module(f"{__name__}.{module}"), name).items()}


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("SQL")
