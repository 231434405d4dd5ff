"""First submission per key ("first row wins" after an ascending time sort).

Order: time ascending with nulls LAST, then an explicit tie-break column, because
Spark rows have no implied order.

Two plans, same result:

* ``method="window"`` (default): ``row_number() over (partition by key order by ...) = 1``.
  Spark plans a partial ``WindowGroupLimit`` before the exchange (rank limit 1), so a key
  holding a third of all rows costs one row per task in the shuffle, and only columns
  that are used later are read.  It depends on that optimizer rule
  (``spark.sql.optimizer.windowGroupLimitThreshold``).
* ``method="aggregate"``: ``groupBy(key).agg(min_by(row, order))``.  The aggregate is
  partial as well and needs no optimizer rule; it also works on a stream.  It sorts
  before and after the exchange and carries every column, so it costs more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def first_per_key(df: DataFrame, keys: str | Sequence[str], time_col: str,
                  tiebreak: str | Sequence[str] = (), method: str = "window") -> DataFrame:
    keys, ties = _as_list(keys), _as_list(tiebreak)
    cols = df.columns
    if method == "window":
        order = [F.asc_nulls_last(time_col)] + [F.asc_nulls_last(t) for t in ties]
        w = Window.partitionBy(*keys).orderBy(*order)
        return (df.withColumn("__rn", F.row_number().over(w))
                  .filter(F.col("__rn") == 1).drop("__rn"))
    if method != "aggregate":
        raise ValueError(f"unknown method {method!r}")
    # (time is null) first in the ordering struct puts null times last.  Tie-break
    # nulls also sort last; the struct compares field by field.
    order = F.struct(F.col(time_col).isNull(), F.col(time_col),
                     *[x for t in ties for x in (F.col(t).isNull(), F.col(t))])
    row = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.min_by(row, order).alias("__first"))
              .select(*[F.col("__first")[c].alias(c) for c in cols]))
