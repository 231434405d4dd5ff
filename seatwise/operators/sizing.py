"""Size checks behind every broadcast and every single-task step.

* ``broadcast_checked``: the rows and bytes of the small side are measured (one
  aggregate); only a side under both bounds is hinted, a larger one is left to a
  shuffled join.
* ``input_partitions``: read tasks implied by Catalyst's estimate (capped: join
  estimates multiply sizes), used to choose between plans with the same result - never
  as a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.session import estimated_bytes

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
MAX_PARTITIONS = 200_000   # estimates of joins multiply sizes; never size a shuffle past this


def _conf_bytes(df: DataFrame, key: str, default: int) -> int:
    v = str(df.sparkSession.conf.get(key, str(default))).strip().lower()
    mult = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    v = v.removesuffix("b")
    if v and v[-1] in mult:
        return int(float(v[:-1]) * mult[v[-1]])
    return int(v)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and the bytes they take, about: 8 a column and row, and the bytes of
    text, binary and nested values."""
    wide = [F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema.fields
            if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    width = F.lit(8 * (len(df.columns) + 1)).cast("long")
    for w in wide:
        width = width + F.coalesce(w, F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return n, size or 0


def broadcast_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``(F.broadcast(df), True)`` when ``df`` is measured small, else ``(df, False)``."""
    rows, size = measured_size(df)
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(df), True
    return df, False


def input_partitions(df: DataFrame) -> int:
    """Roughly how many tasks will read ``df`` (estimate / maxPartitionBytes)."""
    per = _conf_bytes(df, "spark.sql.files.maxPartitionBytes", 128 << 20)
    return int(min(MAX_PARTITIONS, max(1, -(-estimated_bytes(df) // max(per, 1)))))


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Round-robin ``df`` over ``tasks`` (default: the cluster's cores) when its input
    would give fewer read tasks than that - e.g. one large row group, which Spark
    cannot split, feeding CPU-heavy per-row work such as regexes over whole texts.
    With enough input splits (any large table) it returns ``df`` unchanged."""
    if not tasks:
        try:
            tasks = df.sparkSession.sparkContext.defaultParallelism
        except Exception:      # no JVM context: use the session's shuffle width
            tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if input_partitions(df) >= tasks:
        return df
    return df.repartition(tasks)
