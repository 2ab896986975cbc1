"""What a name must be, said once for one value and for a column, so that refusals and lint agree."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import is_identifier, stripped


@dataclass(frozen=True)
class Rule:
    """A rule that a name may break, and the text that says so."""

    text: str
    broken: Callable[[str], bool]
    broken_in: Callable[[Column], Column]


FLAT = (
    Rule("empty or padded", lambda s: not s or s != s.strip(), lambda c: c.isNull() | (c == "") | (stripped(c) != c)),
    Rule("not flat", lambda s: s.startswith(".") or bool({"/", "\\"} & set(s)), lambda c: c.contains("/") | c.contains("\\") | c.startswith(".")),
)
UNIT = (Rule("not an identifier", lambda s: not s.isidentifier(), lambda c: ~is_identifier(c)),)
EXTERNAL = (
    Rule("absolute", lambda s: s.startswith("/"), lambda c: c.startswith("/")),
    Rule("climbs out", lambda s: ".." in s.split("/"), lambda c: F.array_contains(F.split(c, "/"), "..")),
)


def ends_in(suffix: str) -> Rule:
    """A name that already has the suffix which its file will get."""
    return Rule("repeats suffix", lambda s: s.endswith(suffix), lambda c: F.coalesce(c.endswith(suffix), F.lit(False)))


def problem(rules: Sequence[Rule], name: str) -> str | None:
    """The text of the first rule that ``name`` breaks."""
    return next((rule.text for rule in rules if rule.broken(name)), None)


def problem_column(rules: Sequence[Rule], name: Column) -> Column:
    """:func:`problem` of every value; null where all rules hold."""
    first, *rest = rules
    return reduce(lambda found, rule: found.when(rule.broken_in(name), rule.text), rest, F.when(first.broken_in(name), first.text))
