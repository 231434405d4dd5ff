"""Lookups that survive a hot key.

A shuffled join sends all rows of a key to one task.  ``lookup`` joins rows to a table of
one row per key and takes the hot keys out first: keys that more than a ten-thousandth of
the rows have are at most ten thousand, so what the table says about them is broadcast
whatever the data; only the other rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 10_000        # a key is hot when it has more than one of so many rows
LEAST_ROWS = 10_000      # and at least so many


def hot_keys(rows: DataFrame, key: str, least: int = LEAST_ROWS) -> DataFrame | None:
    """The hot values of ``key`` (at most ``MOST_HOT`` rows), None when there are none."""
    n = rows.count()
    hot = (rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
           .filter(F.col("__n") > max(least, n // MOST_HOT)).select(key))
    return None if n <= least or hot.isEmpty() else hot


def lookup(rows: DataFrame, key: str, table: DataFrame, how: str = "left", least: int = LEAST_ROWS) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row per ``key``.

    ``how``: "left" or "inner".  A null key finds nothing and is never shuffled.  ``rows``
    is read three times, so it should be a stored table or a checkpoint.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join {how!r}")
    hot = hot_keys(rows, key, least)
    if hot is None:
        known = rows.filter(F.col(key).isNotNull()).join(table, key, how)
        if how == "inner":
            return known.select(*rows.columns, *[c for c in table.columns if c != key])
        found = F.lit(None)
        none = rows.filter(F.col(key).isNull()).withColumns(
            {c: found.cast(table.schema[c].dataType) for c in table.columns if c != key})
        return known.select(*none.columns).unionByName(none)
    hot = F.broadcast(hot)
    marked = rows.join(hot.withColumn("__hot", F.lit(True)), key, "left")
    apart = F.col("__hot").isNotNull() | F.col(key).isNull()
    few = F.broadcast(table.join(hot, key, "left_semi"))
    out = marked.filter(apart).join(few, key, how).unionByName(marked.filter(~apart).join(table, key, how))
    return out.select(*rows.columns, *[c for c in table.columns if c != key])
