"""Plan building blocks: staged tables, checked broadcasts, distributed ordering."""

from .joins import lookup
from .ordering import Ordered, row_numbers
from .staging import bounded, bounded_by, literal_rows, new_scratch, release_scratch, row_count, staged

__all__ = ["Ordered", "bounded", "bounded_by", "literal_rows", "lookup", "new_scratch", "release_scratch", "row_count", "row_numbers", "staged"]
