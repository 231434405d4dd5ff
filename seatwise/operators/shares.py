"""Shares of counts, inside groups or of the grand total.

These run on aggregated rows (one per level and group), never on the raw table.  The table
is stored first, so what it was counted from is read once; the sums are aggregates of their
own over the stored rows, not windows, so no task holds all levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.session import stored


def share_within(df: DataFrame, groups: str | Sequence[str], n: str = "n",
                 name: str = "p") -> DataFrame:
    """``n / sum(n)`` inside each group (the denominator counts only the rows present,
    so filter before calling)."""
    groups, df = [groups] if isinstance(groups, str) else list(groups), stored(df)
    # a second, smaller aggregate joined back: no task holds all levels of a group
    totals = df.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.sum(n).alias("__total"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return df.join(totals, same).withColumn(name, F.col(n) / F.col("__total")).select(*df.columns, name)


def share_of_total(df: DataFrame, n: str = "n", name: str = "p") -> DataFrame:
    """``n / sum(n)`` over all rows of an aggregated table (one row per level)."""
    df = stored(df)
    return df.withColumn(name, F.col(n) / df.agg(F.sum(n)).scalar())
