"""Text, path, name and date expressions used across the layers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: name rules and text formats that results depend on ---------
EDGE_WHITESPACE = r"(?U)^\s+|\s+$"
IDENTIFIER = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*$"
DATE_FORMAT = "yyyy-MM-dd"
DATETIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TIME_FORMAT = "HH:mm:ss.SSSSSS"
# ------------------------------------------------------------------------------


def stripped(text: Column) -> Column:
    """Remove all whitespace at both edges (``trim`` would remove spaces only)."""
    return F.regexp_replace(text, EDGE_WHITESPACE, "")


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def code_hash(code: Column) -> Column:
    """Hash of a code unit that ignores whitespace at its edges."""
    return sha256(stripped(code).cast("binary"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """Last path part without its extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``; a path elsewhere is returned unchanged."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def base_type(type_name: Column) -> Column:
    """``decimal(10,2)`` -> ``decimal``."""
    return F.substring_index(type_name, "(", 1)


def removed_suffix(text: Column, ending: str) -> Column:
    cut = F.substring(text, F.lit(1), F.length(text) - len(ending))
    return F.when(text.endswith(ending), cut).otherwise(text)


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``S`` and 7 -> ``S07``; wider numbers are kept whole."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def joined(values: Column, separator: str = ", ") -> Column:
    return F.array_join(values, separator)


def ancestors(dotted: Column) -> Column:
    """``a.b.c`` -> ``[a, a.b]``; empty for an undotted name."""
    parts = F.split(dotted, r"\.")
    upto = F.greatest(F.size(parts) - 1, F.lit(1))
    prefixes = F.transform(F.sequence(F.lit(1), upto), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>"))


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(IDENTIFIER), F.lit(False))


def epoch_day(date: Column) -> Column:
    return F.unix_date(date)


def from_epoch_day(day: Column) -> Column:
    return F.date_from_unix_date(day.cast("int"))


def date_text(date: Column) -> Column:
    return F.date_format(date, DATE_FORMAT)


def datetime_text(ts: Column) -> Column:
    return F.date_format(ts, DATETIME_FORMAT)


def time_text(ts: Column) -> Column:
    """Time of day; the form in which a time column can be published."""
    return F.date_format(ts, TIME_FORMAT)
