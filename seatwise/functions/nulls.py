"""Null rules, stated once.

=================  =============================================
if_else            null condition -> null (three-valued)
case_default       null condition -> the default
is_in              membership is never null: null -> False
keep_in            filter on membership (null dropped; pushed to the scan)
filter (Spark)     null condition drops the row
filter_out         null condition KEEPS the row
=================  =============================================
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def if_else(cond: Column, yes, no) -> Column:
    """Three-valued if: ``cond`` null gives null (``.otherwise`` would give ``no``)."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def case_default(cond: Column, value, default) -> Column:
    """Case with a default: a null condition takes the default."""
    value = value if isinstance(value, Column) else F.lit(value)
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(cond, value).otherwise(default)


def is_in(col, values: Iterable) -> Column:
    """Membership in a literal list that is never null (null input -> False)."""
    return F.coalesce(_c(col).isin(list(values)), F.lit(False))


def keep_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Rows whose ``col`` is in ``values``.  Inside a filter a plain ``IN`` already
    drops nulls (same rows as ``is_in``), and unlike ``coalesce(IN, false)`` it is
    pushed down to the parquet reader."""
    return df.filter(F.col(col).isin(list(values)))


def filter_out(df: DataFrame, cond: Column) -> DataFrame:
    """Drop rows where ``cond`` is true; rows where it is null are kept."""
    return df.filter(~F.coalesce(cond, F.lit(False)))
