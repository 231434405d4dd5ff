"""Weighted sampling without replacement, repeatable under any partitioning.

Drawing one by one with probability proportional to the remaining weights gives the
same distribution over sets as keeping the ``k`` smallest keys ``-ln(u_i) / w_i``
(Efraimidis & Spirakis, "Weighted random sampling with a reservoir", 2006).

``u_i`` comes from a hash of ``seed`` and the row id, not from ``rand(seed)``: rand
depends on which task sees which row, the hash does not.  So the drawn set depends
only on (seed, ids, weights): a recomputed task draws the same rows, and DuckDB can
reproduce the set with the same expression.

    u = (int(first 13 hex digits of md5("<seed>:<id>"), 16) + 0.5) / 2**52

Plans
-----
* ``strategy="topk"``: ``orderBy(key, id).limit(k)`` -> TakeOrderedAndProject: each
  task keeps its own k best, one task merges k x tasks rows.  For the seat counts
  of a course (k in the hundreds) this is the whole cost of one scan.  ``auto``
  uses it only while k <= TOPK_MAX and k x (estimated input tasks) <=
  TOPK_MERGE_ROWS, so the merge task does not grow with the data.
* ``strategy="threshold"`` for large k: one partial aggregate builds a histogram of
  the keys on a log2 grid (at most about 33k buckets - the double range times 16 -
  whatever the data size); the driver finds the bucket holding the k-th key; the
  scan keeps keys up to it (k plus one bucket of rows, an exact count); an exact
  rank cuts at k (one task up to a million candidates, the two-phase ordinal
  beyond).  No task ever holds more than a range partition of the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.operators.ordinal import ordinal
from seatwise.operators.sizing import input_partitions

TOPK_MAX = 100_000        # above this k the threshold plan is used
TOPK_MERGE_ROWS = 5_000_000  # ... and also when k x input tasks would exceed this in one merge
_BUCKETS_PER_OCTAVE = 16  # key histogram resolution (2**(1/16) ~ 4.4 % per bucket)
SINGLE_TASK_ROWS = 1_000_000  # threshold plan: candidates ranked in one task up to this


def hash_uniform(id_col, seed: int | Column) -> Column:
    """u in (0, 1) from md5("<seed>:<id>"): 52 bits, centred in its cell.  ``seed`` may
    be a column (many independent draws in one job)."""
    c = id_col if isinstance(id_col, Column) else F.col(id_col)
    prefix = F.concat(seed.cast("string"), F.lit(":")) if isinstance(seed, Column) else F.lit(f"{seed}:")
    h = F.md5(F.concat(prefix, c.cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2 ** 52))


def sampling_key(id_col, weight: Column, seed: int | Column) -> Column:
    """Exponential race key; the k smallest form the sample."""
    return -F.log(hash_uniform(id_col, seed)) / weight


def checked_weight(weight: str | Column | None, wc: Column, null_weight: str, negative_weight: str) -> tuple[Column, Column]:
    """The weight as a double (null when it is none) and, on the column ``wc`` that holds it,
    the condition of rows that can be drawn; it raises for weights that are refused."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    w = w.cast("double")
    # NaN and infinity are no weights: refused or skipped like null, whatever the plan
    w = F.when(F.isnan(w) | (w == F.lit(float("inf"))), F.lit(None)).otherwise(w)
    if null_weight == "error":
        keep = F.coalesce(wc > 0, F.raise_error(F.lit("null or non-finite weight in weighted_sample")).cast("boolean"))
    elif null_weight == "skip":
        keep = wc > 0
    else:
        raise ValueError(f"unknown null_weight {null_weight!r}")
    if negative_weight == "error":
        keep = F.when(wc < 0, F.raise_error(F.lit("negative weight in weighted_sample")).cast("boolean")) \
                .otherwise(keep)
    elif negative_weight != "skip":
        raise ValueError(f"unknown negative_weight {negative_weight!r}")
    return w, keep


def weighted_sample(df: DataFrame, k: int, id_col: str, weight: str | Column | None = None,
                    seed: int = 1, on_short: str = "error", null_weight: str = "error",
                    strategy: str = "auto", negative_weight: str = "error") -> DataFrame:
    """Draw ``k`` rows of ``df`` without replacement, chance proportional to ``weight``.

    ``weight=None`` is the uniform draw.  Rows with weight 0 are never drawn.  A
    null, NaN or infinite weight raises (``null_weight="error"``) or is skipped
    (``"skip"``); so does a negative one (``negative_weight``).  When
    fewer than ``k`` rows can be drawn, ``on_short="error"`` raises and ``"all"``
    returns every drawable row.  Returns the drawn rows with all their columns.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    wc = F.col("__w")
    w, keep = checked_weight(weight, wc, null_weight, negative_weight)
    eligible = df.withColumn("__w", w).filter(keep).withColumn("__key", sampling_key(id_col, wc, seed)) \
        .drop("__w")
    if strategy == "auto":
        small_merge = k * input_partitions(df) <= TOPK_MERGE_ROWS
        strategy = "topk" if k <= TOPK_MAX and small_merge else "threshold"
    if strategy == "topk":
        drawn = eligible.orderBy(F.col("__key"), F.col(id_col)).limit(k).drop("__key")
    elif strategy == "threshold":
        drawn = _threshold_draw(eligible, k, id_col)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if on_short == "error":
        got = drawn.count()
        if got < k:
            raise ValueError(f"cannot draw {k} rows: only {got} have a positive weight")
    elif on_short != "all":
        raise ValueError(f"unknown on_short {on_short!r}")
    return drawn


def _threshold_draw(eligible: DataFrame, k: int, id_col: str) -> DataFrame:
    bucket = F.floor(F.log2(F.col("__key")) * _BUCKETS_PER_OCTAVE).cast("long")
    keyed = eligible.withColumn("__bucket", bucket)
    hist = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    total, cut = 0, None
    for row in sorted(hist, key=lambda r: r["__bucket"]):
        total += row["n"]
        if total >= k:
            cut = row["__bucket"]
            break
    cand = keyed if cut is None else keyed.filter(F.col("__bucket") <= F.lit(cut))
    # The histogram gives the exact candidate count: one task when it is small.
    method = "window" if total <= SINGLE_TASK_ROWS else "range"
    ranked = ordinal(cand.drop("__bucket"), ["__key", id_col], name="__rank", method=method)
    return ranked.filter(F.col("__rank") <= k).drop("__rank", "__key")
