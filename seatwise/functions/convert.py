"""Text -> number / timestamp conversions that give null instead of failing.

ANSI mode is on by default in Spark 4, where a plain ``cast`` of a bad string raises;
``try_cast`` / ``try_to_timestamp`` keep the row and give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


DECIMAL = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def to_number(col) -> Column:
    """Text -> double; null when the text is not a decimal number (type suffixes and words
    such as ``30d`` or ``NaN``, which a plain cast takes, are none)."""
    c = _c(col).cast("string")
    return F.when(c.rlike(DECIMAL), c.try_cast("double"))


def as_double(df, col: str) -> Column:
    """``col`` as a double: numeric columns are cast directly, text goes through
    ``to_number`` (null when not a number)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.NumericType):
        return F.col(col).cast("double")
    return to_number(col)


def to_timestamp_utc(col, fmt: str | None = None) -> Column:
    """Text -> timestamp read in the session time zone (UTC here); null when unparsable."""
    c = _c(col).cast("string")
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def as_timestamp(df, col: str) -> Column:
    """``col`` as a timestamp the way the intake reads closing times: timestamps as
    they are, numbers as seconds since the epoch (UTC), text parsed in the session
    time zone (null when unparsable)."""
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.col(col)
    if isinstance(dt, T.NumericType):
        return F.timestamp_seconds(F.col(col))
    return to_timestamp_utc(col)


def timestamp_literal(value: str, like: T.DataType | None = None) -> Column:
    """A timestamp literal of the same kind as the column it is compared with."""
    if isinstance(like, T.TimestampNTZType):
        return F.lit(value).cast("timestamp_ntz")
    return F.to_timestamp(F.lit(value))
