"""Expected chances of the weighted draw, before anything is drawn.

The draw keeps the ``k`` smallest keys ``-ln(u) / w``: an exponential clock of rate ``w`` per
row, and a row is drawn when its clock rings among the first ``k``.  By time ``t`` a row's
clock has rung with chance ``1 - exp(-w t)``; at the time at which ``k`` clocks are expected to
have rung, these are the chances of the sequential draw.  They sum to ``k``.  With equal
weights they are exactly ``k / n``; otherwise they differ from the draw's by at most about one
row's share, less the more rows there are (a test compares them with simulated draws).

Rows count only by weight, so the time is found on a stored table of (weight, rows): one
aggregate a pass evaluates a grid of times, and the next grid lies between the two around
``k``.  The passes depend on the precision of a double, not on the data, and the driver gets
one row of sums a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.operators.sampling import checked_weight
from seatwise.session import stored

GRID = 32             # times evaluated by one pass
PRECISION = 1e-14     # relative width of the last bracket
PASSES = 30           # at most; twelve bring any bracket of doubles down to it


def expected_clock(counts: DataFrame, k: int) -> float:
    """The time at which ``k`` of the clocks in ``counts`` (``w`` > 0, ``n`` rows of it) are
    expected to have rung; infinity when there are no more than ``k`` of them."""
    rows, mass, least = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("w")), F.min("w")).first()
    if not rows or k >= rows:
        return float("inf")
    if k == 0:
        return 0.0
    low = k / mass                                                # the expectation is concave in t
    # as if every row had the least weight: -ln(1 - k / rows) / least
    high = max(low, float(counts.sparkSession.range(1).select(-F.log1p(F.lit(-k / rows)) / F.lit(least)).first()[0]))
    for _ in range(PASSES):
        if high <= low * (1 + PRECISION):
            break
        step = (high / low) ** (1 / (GRID + 1))
        times = [low, *[low * step ** i for i in range(1, GRID + 1)], high]
        rung = counts.agg(*[F.sum(F.col("n") * -F.expm1(-F.col("w") * F.lit(t))) for t in times[1:-1]]).first()
        below = sum(r < k for r in rung)
        if (times[below], times[below + 1]) == (low, high):
            break
        low, high = times[below], times[below + 1]
    return low + (high - low) / 2


def inclusion_chances(df: DataFrame, k: int, weight: str | Column | None = None, name: str = "chance",
                      null_weight: str = "error", negative_weight: str = "error") -> DataFrame:
    """``df`` with ``name``: each row's chance to be among ``k`` rows of ``weighted_sample``.

    The rules on weights are the draw's: weight 0 has chance 0; a null, NaN, infinite or
    negative one raises or, with "skip", has chance 0.  When no more than ``k`` rows can be drawn,
    each of them has chance 1.  ``df`` is read twice.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    w, keep = checked_weight(weight, F.col("__w"), null_weight, negative_weight)
    weighed = df.withColumn("__w", w)
    counts = stored(weighed.filter(keep).groupBy(F.col("__w").alias("w")).agg(F.count(F.lit(1)).alias("n")))
    t = expected_clock(counts, k)
    chance = F.lit(1.0) if t == float("inf") else -F.expm1(-F.col("__w") * F.lit(t))
    return weighed.withColumn(name, F.when(F.coalesce(keep, F.lit(False)), chance).otherwise(0.0)).drop("__w")
