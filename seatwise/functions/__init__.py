"""Column -> Column helpers.  All of them build JVM expressions; none is a Python UDF."""

from seatwise.functions.nulls import case_default, filter_out, if_else, is_in, keep_in
from seatwise.functions.text import (
    percent_label, remove_all, replace_all, replace_each_first, replace_first, slug, squish,
    title_case, wrap,
)
from seatwise.functions.convert import as_double, as_timestamp, to_number, to_timestamp_utc, timestamp_literal
from seatwise.functions.recode import recode

__all__ = [
    "case_default", "filter_out", "if_else", "is_in", "keep_in",
    "percent_label", "remove_all", "replace_all", "replace_each_first", "replace_first",
    "slug", "squish", "title_case", "wrap",
    "as_double", "as_timestamp", "to_number", "to_timestamp_utc", "timestamp_literal", "recode",
]
