"""Exact quantiles (linear interpolation between order statistics) with bounded memory.

An exact ``percentile`` aggregate keeps every distinct value in one buffer.  Here the
order statistics are found by narrowing value brackets, all of them in the same passes:

1. one pass counts, and a quantile sketch gives a bracket around each wanted rank
   (widened by the sketch's rank error);
2. one aggregate counts the values below and inside each bracket;
3. one filtered pass collects the (value, count) pairs of brackets with at most
   ``max_collect`` values, and the order statistics are read off.

So three passes do, whatever the number of quantiles.  Between 2 and 3, a bracket with
more values is cut into ``buckets`` equal-width buckets and shrinks to the bucket that
holds its rank: one more pass for each factor of ``buckets`` in size.  A value repeated
in a third of the rows ends the search as soon as the bracket holds only that value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 100_000
MARGIN = 2.0 / SKETCH_ACCURACY


@dataclass
class _Bracket:
    """Values in [a, b], among them the one of the wanted rank; ``below`` are smaller."""

    rank: int
    a: float
    b: float
    below: int = 0
    inside: int = 0
    value: float | None = None

    def has(self, x: Column) -> Column:
        return (x >= F.lit(self.a)) & (x <= F.lit(self.b))


def sketch(probs) -> Column:
    """The sketch quantiles that bracket ``probs``, for the caller's own first pass."""
    ends = [q for p in probs for q in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    return F.percentile_approx("x", ends, SKETCH_ACCURACY)


def _ranks(n: int, p: float) -> list[int]:
    j = math.floor((n - 1) * p)
    return [j] if j + 1 >= n or (n - 1) * p == j else [j, j + 1]


def _count(xs: DataFrame, brackets: list[_Bracket], lo: float, hi: float) -> None:
    """Count below and inside; a bracket that the sketch put wrong is widened and counted
    again."""
    x, todo = F.col("x"), brackets
    while todo:
        s = xs.agg(*[e for i, k in enumerate(todo) for e in (
            F.count_if(x < F.lit(k.a)).alias(f"b{i}"), F.count_if(k.has(x)).alias(f"c{i}"),
            F.min(F.when(k.has(x), x)).alias(f"mn{i}"), F.max(F.when(k.has(x), x)).alias(f"mx{i}"))]).first()
        again = []
        for i, k in enumerate(todo):
            k.below, k.inside = s[f"b{i}"], s[f"c{i}"]
            if k.rank < k.below:
                k.a = lo
            elif k.rank >= k.below + k.inside:
                k.b = hi
            elif s[f"mn{i}"] == s[f"mx{i}"]:
                k.value = float(s[f"mn{i}"])
                continue
            else:
                k.a, k.b = s[f"mn{i}"], s[f"mx{i}"]
                continue
            again.append(k)
        todo = again


def _narrow(xs: DataFrame, brackets: list[_Bracket], buckets: int) -> None:
    """One pass: each bracket shrinks to the bucket that holds its rank."""
    x = F.col("x")
    at = F.array_compact(F.array(*[
        F.when(k.has(x), F.struct(F.lit(i).alias("k"), F.least(F.floor((x / 2 - F.lit(k.a / 2)) / F.lit((k.b / 2 - k.a / 2) / buckets)),
                                                               F.lit(buckets - 1)).alias("i")))
        for i, k in enumerate(brackets)]))
    rows = (xs.select("x", F.explode(at).alias("at")).groupBy("at.k", "at.i")
            .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx")).collect())
    # The bucket number never falls with x, so earlier buckets hold smaller values only.
    for r in sorted(rows, key=lambda r: (r["k"], r["i"])):
        k = brackets[r["k"]]
        if k.inside < 0:
            continue
        if k.below + r["c"] > k.rank:
            k.a, k.b, k.inside = r["mn"], r["mx"], -r["c"]        # negative: settled in this pass
            if k.a == k.b:
                k.value = float(k.a)
        else:
            k.below += r["c"]
    for k in brackets:
        k.inside = abs(k.inside)


def exact_quantiles(xs: DataFrame, probs, n: int | None = None, lo: float | None = None,
                    hi: float | None = None, max_collect: int = 100_000, buckets: int = 1024,
                    sketched: list[float] | None = None) -> list[float]:
    """Type-7 quantiles of the finite double column ``x`` of ``xs``.  A caller that has
    made the first pass gives count, ends and ``sketch`` values."""
    probs = list(probs)
    if n is None or lo is None or hi is None or sketched is None:
        s = xs.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                   sketch(probs).alias("q")).first()
        n, lo, hi, sketched = s["n"], s["lo"], s["hi"], s["q"]
    if not n:
        return [None for _ in probs]
    found: dict[int, _Bracket] = {}
    for i, p in enumerate(probs):
        for r in _ranks(n, p):
            found.setdefault(r, _Bracket(r, min(sketched[2 * i:2 * i + 2]), max(sketched[2 * i:2 * i + 2])))
    brackets = list(found.values())
    _count(xs, brackets, lo, hi)
    while big := [k for k in brackets if k.value is None and k.inside > max_collect and (k.b / 2 - k.a / 2) / buckets > 0]:
        _narrow(xs, big, buckets)
    rest = [k for k in brackets if k.value is None]
    if rest:
        wanted = rest[0].has(F.col("x"))
        for k in rest[1:]:
            wanted = wanted | k.has(F.col("x"))
        held = sorted((r["x"], r["c"]) for r in xs.filter(wanted).groupBy("x").agg(F.count(F.lit(1)).alias("c")).collect())
        for k in rest:
            run = k.below
            for x, c in held:
                if k.a <= x <= k.b:
                    run += c
                    if run > k.rank:
                        k.value = float(x)
                        break
    out = []
    for p in probs:
        h = (n - 1) * p
        low, *high = [found[r].value for r in _ranks(n, p)]
        out.append(low if not high else low + (h - math.floor(h)) * (high[0] - low))
    return out
