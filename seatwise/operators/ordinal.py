"""Global ordinal 1..n over a total order (``row_number()`` over the whole table).

``method="window"`` is the textbook form: one window without partitioning, which
Spark runs as ``Exchange SinglePartition`` - every row through one task.  Fine for a
few thousand rows, wrong at scale.  ``method="auto"`` (default) picks it only when
Catalyst's size estimate of the input is at most ``single_task_bytes`` (64 MiB).

``method="range"`` is the two-phase ordinal:

1. ``repartitionByRange`` on the sort key plus a row hash as the last key (so a
   value held by a third of the rows is split across ranges even when the given
   order is not total), sort within partitions, and stamp ``spark_partition_id()``
   and the in-partition position.  Without ``num_partitions`` the exchange takes
   the session's shuffle partitions and AQE merges small neighbouring ranges.
2. ``checkpoint()`` that into ``spark.checkpoint.dir``: range bounds are sampled, so
   a recomputation after a lost executor could move rows between ranges.  The
   checkpoint fixes them.
3. Count per partition: one number per partition comes to the driver (size bound =
   number of partitions), becomes an array literal of running offsets, and each row
   adds its partition's offset - no join, no single-partition step.

Every step is a scan, one shuffle of the rows, or a tiny aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.operators.sizing import measured_size
from seatwise.operators.sorting import SortSpec, sort_cols
from seatwise.session import ensure_checkpoint_dir, estimated_bytes, stored

SINGLE_TASK_BYTES = 64 * 1024 * 1024   # auto: at most this much goes through one task

_POS_BITS = 33   # monotonically_increasing_id = partition_id << 33 | row number in partition


def ordinal(df: DataFrame, order: Sequence[SortSpec], name: str = "id",
            method: str = "auto", num_partitions: int | None = None,
            single_task_bytes: int = SINGLE_TASK_BYTES) -> DataFrame:
    """Add ``name`` = 1..n following ``order`` (``"x"`` asc, ``"-x"`` desc, nulls last).

    Rows that tie in the order are numbered by a hash of all their columns, so the result
    is repeatable; only rows equal in every column are interchangeable.  Select the needed columns first: the two-phase plan checkpoints ``df`` and no
    column can be pruned through a checkpoint.  ``method="auto"`` takes the window
    when Catalyst's size estimate of ``df`` is at most ``single_task_bytes``, and the
    two-phase plan otherwise; both give the same numbers, so the estimate only decides
    about the cost.  ``method="measured"`` stores ``df`` and decides on its measured bytes:
    for a small result of a large plan (a table of levels), which estimates make large.
    """
    # A row hash as the last key, in both plans: ties get the same numbers in any plan and
    # under any partitioning, and a value held by a third of the rows is split across
    # ranges.  With a total order it never decides anything.
    cols = sort_cols(order) + [F.asc(F.xxhash64(*[F.col(c) for c in df.columns]))]
    if method == "measured":
        df = stored(df)
        method = "window" if measured_size(df)[1] <= single_task_bytes else "range"
    if method == "auto":
        method = "window" if estimated_bytes(df) <= single_task_bytes else "range"
    if method == "window":
        return df.withColumn(name, F.row_number().over(Window.orderBy(*cols)).cast("long"))
    if method != "range":
        raise ValueError(f"unknown method {method!r}")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Without a forced count the exchange uses the session's shuffle partitions (on a
    # large cluster: spark.sql.adaptive.coalescePartitions.initialPartitionNum) and AQE
    # merges small neighbouring ranges; merged ranges stay contiguous and in order,
    # so partition ids still follow the sort order.
    ranged = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    staged = (ranged.sortWithinPartitions(*cols)
                .withColumn("__pid", F.spark_partition_id())
                .withColumn("__pos", F.monotonically_increasing_id()))
    staged = staged.checkpoint(eager=True)
    counts = dict(staged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n")).collect())
    offsets, run = [], 0
    for pid in range(max(counts, default=-1) + 1):
        offsets.append(run)
        run += counts.get(pid, 0)
    off = F.lit(offsets).cast("array<bigint>") if offsets else F.array().cast("array<bigint>")
    mask = (1 << _POS_BITS) - 1
    return (staged.withColumn(name, (F.element_at(off, F.col("__pid") + 1)
                                     + F.col("__pos").bitwiseAND(F.lit(mask)) + 1).cast("long"))
                  .drop("__pid", "__pos"))


def head_rows(df: DataFrame, order: Sequence[SortSpec], n: int = 6) -> DataFrame:
    """First ``n`` rows in ``order`` (TakeOrderedAndProject: top-n per task, then merge)."""
    return df.orderBy(*sort_cols(order)).limit(n)


def tail_rows(df: DataFrame, order: Sequence[SortSpec], n: int = 6) -> DataFrame:
    """Last ``n`` rows in ``order``, returned in ``order``."""
    return df.orderBy(*sort_cols(order, reverse=True)).limit(n).orderBy(*sort_cols(order))
