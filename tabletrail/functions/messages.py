"""Severities and the exact texts an audit reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ERROR = "error"
WARNING = "warning"

OUTPUT_MISSING = "{}: missing"
OUTPUT_SIZE = "{}: size changed since it was written"
OUTPUT_CONTENT = "{}: content changed since it was written"
INPUT_MISSING = "input missing: {}"
INPUT_OLD_VERSION = "built from an older version of {}; re-run this cell"
INPUT_EXTERNAL_CHANGED = "external input changed: {}"
INPUT_CHANGED = "input changed: {}"
MODULE_MISSING = "module missing: {}"
MODULE_CHANGED = "{} changed since this was written; re-run the cell"
CELLS_UNREADABLE = "cannot read cells of {}"
NO_MATCHING_CELL = "no cell in {} matches the code that produced this table; the producer was edited or removed"
NO_SUCH_CELL = "no cell named '{}' in {}; the cell was renamed or deleted, orphaning this bundle"
CELL_CHANGED = "cell '{}' changed since this was written; re-run it to update the artifact"
MANIFEST_UNREADABLE = "unreadable manifest"
MANIFEST_LATER = "{} has manifest_version {}; this version reads up to {}"
FILE_UNRECORDED = "no manifest records this file; {} did not write it"
SHARED_WRITER = "save_shared()"
PRESERVED_WRITER = "preserve_*()"


def filled(template: str, *values: Column) -> Column:
    """The template with each ``{}`` replaced by a column; a null value reads None."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [F.coalesce(value.cast("string"), F.lit("None")), F.lit(piece)]
    return F.concat(*parts)
