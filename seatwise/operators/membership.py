"""Membership tests against a key list (``x %in% list``): semi-join and flag.

Null keys never match and rows never multiply (the list is de-duplicated).  The list
is stored, so that it is computed once, and broadcast only after its rows and bytes have been
measured; a longer or wider list is joined with a shuffle (AQE splits a skewed side), and
the rows are thinned by a bitmap of the list before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.operators.bitmaps import possible_members
from seatwise.operators.sizing import broadcast_checked
from seatwise.session import stored

MAX_BROADCAST_ROWS = 1_000_000


def _keys(keys: DataFrame, key_col: str, on: str, max_broadcast_rows: int) -> tuple[DataFrame, bool]:
    k = keys.select(F.col(key_col).alias(on)).filter(F.col(on).isNotNull()).distinct()
    return broadcast_checked(stored(k), max_broadcast_rows)


def in_list(df: DataFrame, on: str, keys: DataFrame, key_col: str = "value",
            max_broadcast_rows: int = MAX_BROADCAST_ROWS, thin: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in the list (exact, case-sensitive match).  ``thin``:
    whether a bitmap takes rows out before a shuffled join (the result is the same)."""
    k, small = _keys(keys, key_col, on, max_broadcast_rows)
    if thin and not small and df.schema[on].dataType == k.schema[on].dataType:      # equal hashes need equal types
        df = possible_members(df, on, k, k.count())
    return df.join(k, on=on, how="left_semi")


def membership_flag(df: DataFrame, on: str, keys: DataFrame, flag: str, key_col: str = "value",
                    max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add boolean ``flag`` = ``on`` is in the list (never null)."""
    k = _keys(keys, key_col, on, max_broadcast_rows)[0].withColumn(flag, F.lit(True))
    return df.join(k, on=on, how="left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
