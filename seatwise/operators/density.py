"""Gaussian kernel density of a numeric column on an evenly spaced grid.

Bandwidth by the normal-reference rule (``nrd0``):
``0.9 * min(sd, IQR / 1.34) * N^-0.2`` (falling back to ``sd``, then ``|x|``, then 1
when that minimum is 0), with quartiles by linear interpolation between order
statistics.  The output grid runs from min - cut*h to max + cut*h (cut=0: the data
range, which is what the density charts use).

Statistics: one aggregate over the (pruned) column gives n, sd, min, max and sketch
quartiles - one row to the driver.  The quartiles are then made exact (default) by
bracket refinement (``operators/quantiles``: bounded memory, two more scans);
``quantiles="approx"`` keeps the sketch.  Values that are not finite are left out.

``method="binned"`` (default) is the estimator the charts were drawn with (R's
``density``): every value is split linearly between the two nearest of 512 bins
spanning [min - 4h, max + 4h] (Spark: two weighted rows per value, summed per bin -
at most 512 rows leave the scan); the bins are convolved with the Gaussian kernel
(bin distances measured with the kernel grid step 2(up - lo)/(2*512 - 1), as the
FFT form of that estimator does) and the result is interpolated linearly onto the
output grid.  The convolution and the interpolation act on the 512 bin sums only,
so their cost does not depend on the data size.

``method="exact"`` sums ``phi((g - x) / h)`` over every value: the column is
compressed to (value, count), each distinct value adds to every grid point through
a ``posexplode`` of a fixed-length array and a partial aggregate per grid index -
the (value x grid) products are summed inside each task and never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.functions.convert import as_double
from seatwise.operators.quantiles import SKETCH_ACCURACY, exact_quantiles, sketch

BINS = 512                       # bins of the binned estimator (grows to a power of 2 for more points)
SCHEMA = "i int, x double, density double"


def nrd0(n: int, sd: float | None, q1: float, q3: float, xmin: float) -> float:
    hi = sd if sd is not None and not math.isnan(sd) else 0.0
    lo = min(hi, (q3 - q1) / 1.34)
    if not lo:
        lo = hi or abs(xmin) or 1.0
    return 0.9 * lo * n ** -0.2


def _stats(xs: DataFrame, quantiles: str):
    if quantiles not in ("exact", "approx"):
        raise ValueError(f"unknown quantiles {quantiles!r}")
    s = xs.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
               F.min("x").alias("lo"), F.max("x").alias("hi"),
               F.percentile_approx("x", [0.25, 0.75], SKETCH_ACCURACY).alias("q"),
               sketch([0.25, 0.75]).alias("around")).first()
    if not s["n"]:
        return None
    q1, q3 = s["q"]
    if quantiles == "exact":
        q1, q3 = exact_quantiles(xs, [0.25, 0.75], s["n"], s["lo"], s["hi"], sketched=s["around"])
    sd = s["sd"] if s["n"] > 1 else None
    return s["n"], sd, s["lo"], s["hi"], q1, q3


def density(df: DataFrame, col: str, points: int = 512, bw: float | None = None,
            adjust: float = 1.0, cut: float = 0.0, bin_width: float | None = None,
            quantiles: str = "exact", method: str = "binned") -> DataFrame:
    """Rows ``(i, x, density)`` for grid index ``i`` = 0..points-1."""
    if points < 1:
        raise ValueError("points must be >= 1")
    spark = df.sparkSession
    x = as_double(df, col)
    if bin_width:
        x = F.round(x / bin_width) * bin_width
    xs = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != F.lit(float("inf"))))
    st = _stats(xs, quantiles)
    if st is None:
        return spark.createDataFrame([], SCHEMA)
    n, sd, xmin, xmax, q1, q3 = st
    h = (bw if bw is not None else nrd0(n, sd, q1, q3, xmin)) * adjust
    frm, to = xmin - cut * h, xmax + cut * h
    if method == "binned":
        return _binned(xs, n, h, frm, to, points)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    step = (to - frm) / (points - 1) if points > 1 else 0.0
    grid = F.lit([float(frm + i * step) for i in range(points)]).cast("array<double>")
    vals = xs.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    contrib = F.transform(grid, lambda g: F.col("c") * F.exp(-0.5 * ((g - F.col("x")) / F.lit(h)) ** 2))
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    return (vals.select(F.posexplode(contrib).alias("i", "k"))
                .groupBy("i").agg((F.sum("k") * F.lit(norm)).alias("density"))
                .select(F.col("i").cast("int").alias("i"),
                        (F.lit(frm) + F.col("i").cast("double") * F.lit(step)).alias("x"),
                        "density"))


def _binned(xs: DataFrame, n: int, h: float, frm: float, to: float, points: int) -> DataFrame:
    nb = max(points, BINS)
    if nb > BINS:
        nb = 2 ** math.ceil(math.log2(nb))
    lo, up = frm - 4 * h, to + 4 * h
    xdelta = (up - lo) / (nb - 1)
    pos = (F.col("x") - F.lit(lo)) / F.lit(xdelta)
    ix = F.floor(pos).cast("int")
    fx = pos - F.floor(pos)
    parts = F.explode(F.array(F.struct(ix.alias("idx"), (F.lit(1.0) - fx).alias("w")),
                              F.struct((ix + 1).alias("idx"), fx.alias("w"))))
    sums = (xs.select(parts.alias("p")).select("p.idx", "p.w")
              .filter((F.col("idx") >= 0) & (F.col("idx") < nb))
              .groupBy("idx").agg(F.sum("w").alias("c"))).collect()        # at most nb rows
    y = np.zeros(nb)
    for r in sums:
        y[r["idx"]] = r["c"] / n
    kstep = 2 * (up - lo) / (2 * nb - 1)
    # The kernel depends on the distance of two bins only: a convolution, done by FFT over
    # twice the bins so that it does not wrap around.
    dist = np.minimum(np.arange(2 * nb), 2 * nb - np.arange(2 * nb)) * kstep
    kern = np.exp(-0.5 * (dist / h) ** 2) / (h * math.sqrt(2 * math.pi))
    dens = np.maximum(0.0, np.fft.irfft(np.fft.rfft(y, 2 * nb) * np.fft.rfft(kern), 2 * nb)[:nb])
    rows = []
    for i in range(points):
        xu = frm + i * (to - frm) / (points - 1) if points > 1 else frm
        p = (xu - lo) / xdelta
        j0 = min(int(math.floor(p)), nb - 1)
        t = p - j0
        d1 = dens[j0 + 1] if j0 + 1 < nb else dens[j0]
        rows.append((i, float(xu), float(dens[j0] + t * (d1 - dens[j0]))))
    return xs.sparkSession.createDataFrame(rows, SCHEMA)
