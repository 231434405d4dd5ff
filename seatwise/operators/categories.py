"""Category order as an explicit ordinal column (Spark strings have no level order).

* ``relevel_ordinal``: listed levels first, in the order given, then every other
  level in ascending order.
* ``reorder_by``: levels ordered by the median of a measure, ascending; ties keep
  the previous level order.
Levels are in byte order, or with ``collation`` in the order of a language.
Both compute the order on the distinct levels (a small aggregate; the level-order
window runs in one task over one row per level) and join it back, broadcast after
a size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.operators.ordinal import ordinal
from seatwise.operators.sizing import broadcast_checked
from seatwise.operators.sorting import collated


def relevel_ordinal(df: DataFrame, col: str, first: Sequence[str], name: str | None = None,
                    per_level: bool = False, collation: str | None = None) -> DataFrame:
    """Add ``name`` (default ``<col>_ord``): 1.. following the level order.

    ``per_level=True`` says ``df`` already has one row per level (an aggregate):
    the ordinal is then a window over those rows, with no second pass.
    """
    name = name or f"{col}_ord"
    first = list(first)
    pos = None
    for i, v in enumerate(first):
        pos = F.when(F.col(col) == v, F.lit(i)) if pos is None else pos.when(F.col(col) == v, F.lit(i))
    listed = pos if pos is not None else F.lit(None).cast("int")
    if per_level:
        # Null is not a level: number the non-null levels among themselves.
        order = Window.partitionBy(F.col(col).isNull()).orderBy(F.asc_nulls_last(listed), collated(df, col, collation).asc(), F.asc(col))
        return df.withColumn(name, F.when(F.col(col).isNotNull(), F.row_number().over(order)).cast("long"))
    levels = df.filter(F.col(col).isNotNull()).select(col).distinct()
    levels = levels.withColumn("__listed", F.coalesce(listed, F.lit(len(first))))
    # ordinal(): the levels are stored; one task for a small table, the two-phase plan for a large one.
    levels, by = _collated_column(levels, col, collation)
    levels = ordinal(levels, ["__listed", *by, col], name=name, method="measured").select(col, name)
    return df.join(broadcast_checked(levels)[0], on=col, how="left")


def _collated_column(levels: DataFrame, col: str, collation: str | None) -> tuple[DataFrame, list[str]]:
    """The level table with a sort key for the language's order, and that key's name."""
    if collation is None:
        return levels, []
    return levels.withColumn("__collated", collated(levels, col, collation)), ["__collated"]


def level_medians(df: DataFrame, keys: Sequence[str], measure: str, name: str = "median") -> DataFrame:
    """Exact median of ``measure`` per level, null where a level has no value.

    The (level, value) rows are numbered in order over the whole table with the global
    ordinal, so a level that holds a third of the rows is spread over many ranges and no
    buffer holds a level's values.  A level's middle values are those whose number,
    counted from the level's first, is in the middle of its count.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(measure).cast("double").alias("__x"))
    place = ordinal(rows.filter(F.col("__x").isNotNull()), [*keys, "__x"], name="__i")
    span = place.groupBy(*keys).agg(F.min("__i").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    same = None
    for k in keys:
        eq = F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}"))
        same = eq if same is None else same & eq
    nth = F.col("__i") - F.col("__lo")
    middle = (place.alias("p").join(span.alias("s"), same)
              .filter((nth == F.floor((F.col("__n") - 1) / 2)) | (nth == F.floor(F.col("__n") / 2)))
              .groupBy(*[F.col(f"p.{k}").alias(k) for k in keys]).agg(F.avg("__x").alias(name)))
    return rows.select(*keys).distinct().join(middle, on=keys, how="left")


def reorder_by(df: DataFrame, col: str, measure: str, prior: str | None = None,
               name: str | None = None, per_level: bool = False, collation: str | None = None) -> DataFrame:
    """Add ``name`` (default ``<col>_ord``): levels by median ``measure`` ascending,
    ties broken by ``prior`` (an earlier ordinal) or by the level itself.

    ``per_level=True``: one row per level, so the median is the value itself and
    the ordinal is a window over those rows.  Otherwise the exact median per level is
    taken, whatever the number of rows and values (``level_medians``).
    """
    name = name or f"{col}_ord"
    ties = ([F.asc(prior)] if prior else []) + [collated(df, col, collation).asc(), F.asc(col)]
    if per_level:
        order = Window.partitionBy(F.col(col).isNull()).orderBy(F.asc(measure), *ties)
        return df.withColumn(name, F.when(F.col(col).isNotNull(), F.row_number().over(order)).cast("long"))
    keys = [col] + ([prior] if prior else [])
    med = level_medians(df.filter(F.col(col).isNotNull()), keys, measure, "__med")
    med, by = _collated_column(med, col, collation)
    ordered = ordinal(med, ["__med"] + ([prior] if prior else []) + [*by, col], name=name, method="measured").select(col, name)
    return df.join(broadcast_checked(ordered)[0], on=col, how="left")
