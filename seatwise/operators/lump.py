"""Keep the ``n`` most frequent levels of a column, lump the rest into one level.

Rules (those of the factor tools the charts were made with):
* levels are ranked by count descending with ties at the same (minimum) rank, so
  every level tied at rank n is kept;
* when at most one level would fall outside, nothing is lumped;
* null stays null and is not a level.

Plan: the count per level (partial aggregate) is stored once.  The n-th largest count comes
from a top-n of it (``TakeOrderedAndProject``), so no task holds all levels.  Only the kept
levels - n and those tied with the n-th - are joined to the rows; any other non-null value is
lumped.  A table that already has the counts (``lump_counts``) needs neither pass nor join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.operators.sizing import broadcast_checked
from seatwise.session import stored


def least_kept(counts: DataFrame, n: int, name: str) -> int | None:
    """The count from which on a level stays, None when all levels do.  ``counts``: a stored
    table of one row per level, with the count in ``name``."""
    if n < 0:
        raise ValueError("n must be >= 0 (keeping the least frequent levels is not supported)")
    top = counts.select(F.col(name).alias("n")).orderBy(F.desc("n"))
    if n == 0:
        return None if top.limit(2).count() <= 1 else 2 ** 63 - 1
    # the n-th largest count, and how many levels lie below it
    least, have = top.limit(n).agg(F.min("n"), F.count(F.lit(1))).first()
    if have < n or counts.filter(F.col(name) < least).limit(2).count() <= 1:
        return None
    return least


def kept_levels(df: DataFrame, col: str, n: int) -> DataFrame | None:
    """The levels that stay (one column, ``col``); None when all do."""
    counts = stored(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n")))
    least = least_kept(counts, n, "__n")
    return None if least is None else counts.filter(F.col("__n") >= least).select(col)


def lump_counts(counts: DataFrame, col: str, n: int, other: str = "Other", name: str = "n") -> DataFrame:
    """A count table (``col``, ``name``) of one row per level, with all but the ``n`` most
    frequent levels summed up in ``other``.  Null stays a row of its own."""
    counts = stored(counts.select(col, name))
    least = least_kept(counts.filter(F.col(col).isNotNull()), n, name)
    level = F.col(col).cast("string")
    if least is not None:
        level = F.when(F.col(col).isNull() | (F.col(name) >= least), level).otherwise(F.lit(other))
    return counts.select(level.alias(col), name).groupBy(col).agg(F.sum(name).alias(name))


def lump_top_n(df: DataFrame, col: str, n: int, other: str = "Other",
               name: str | None = None) -> DataFrame:
    """Replace ``col`` (or add ``name``) with the lumped level, a text."""
    target = name or col
    cols = [*df.columns] + ([] if target in df.columns else [target])
    kept = kept_levels(df, col, n)
    level = F.col(col).cast("string")
    if kept is None:
        return df.withColumn(target, level).select(*cols)
    levels, _ = broadcast_checked(kept.withColumn("__kept", F.lit(True)))
    out = df.join(levels, on=col, how="left")
    return out.withColumn(target, F.when(F.col("__kept"), level).when(F.col(col).isNotNull(), F.lit(other))).select(*cols)
