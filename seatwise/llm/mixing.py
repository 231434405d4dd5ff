"""Mixing sources to target weights by the cube method.

Each source gets a target share of all words; a document of a source whose target is
``m + f`` times its size (``m`` whole, ``0 <= f < 1``) is taken ``m`` times, and once more
with inclusion probability ``f``.  Which documents get the extra copy is decided by the
cube method (balanced sampling): the vector of probabilities is moved along directions
in the null space of the balancing constraints until every entry is 0 or 1, so the
sample's totals of words and of documents stay those that the probabilities ask for.

The flight runs in parallel.  The open documents of a source are dealt into blocks of a
bounded size by a hash; a block's flight ends with at most as many open entries as there
are constraints (two).  Those survivors alone form the blocks of the next level, until a
source's survivors fit one block; there the last entries are landed, words first.  So no
task ever holds more than one block, and the number of levels grows with the logarithm
of the input.

Defined results: a null or empty text has size 0 and is taken ``m`` times or ``m + 1``
times like any other (no word either way).  Null sources are one source, the last.  A
source without words has target 0.  Repeated rows are separate documents.  The choice
depends on the ids, texts and ``seed`` alone, not on partitioning, so reruns agree (fully
identical rows may change places, which changes no count).
An empty table gives an empty mix.  Other columns pass through; columns that have the
names of results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators.sizing import broadcast_checked
from .common import cut, free_name, number_rows
from .textcore import word_counts

BLOCK = 2048          # open documents a flight handles at once
MAX_RATIO = 3         # a source's target stops at so many times its size
WEIGHTS = (1, 2, 3)   # weights of the sources in order, repeating
_EPS = 1e-9


@F.arrow_udf(LongType())
def _words(texts: pa.Array) -> pa.Array:
    return pa.array(word_counts(texts), type=pa.int64())


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Target words of each source from (key, source_size): all words shared by weight,
    none above ``max_ratio`` times its size, the excess shared again among the others.

    Sources are filled in order of size per weight: those whose fair share of what is
    left exceeds their bound stop there, the rest share what remains.  One row per
    source; the windows run over that table only."""
    order = Window.orderBy(F.col("key.v").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("bound", F.lit(float(max_ratio)) * F.col("source_size"))
    fill = Window.orderBy(F.col("bound") / F.col("w"), F.col("key.v").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    # stopped sources come first in this order; the first that is not has the highest level
    # of those that stay within their bounds, and all after it share alike
    level = (total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    t = t.withColumn("level", level)
    free = F.max(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.col("level"))).over(everything)
    # an all-zero table has no free level; nothing is shared then
    return (t.withColumn("free", F.coalesce(free, F.lit(0.0)))
            .select("key", "source_size", F.least("bound", F.col("free") * F.col("w")).alias("target")))


def flight(pi: np.ndarray, size: np.ndarray, rand: np.ndarray) -> np.ndarray:
    """Cube flight over one block: move ``pi`` in the null space of the constraints
    (sum of pi, sum of pi * size) until at most two entries are open."""
    pi = pi.copy()
    open_ = [i for i in range(len(pi)) if _EPS < pi[i] < 1 - _EPS]
    at = min(3, len(open_))
    held = open_[:at]
    while len(held) == 3:
        a, b, c = held
        # direction with d_a + d_b + d_c = 0 and s_a d_a + s_b d_b + s_c d_c = 0
        d = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if d == (0, 0, 0):
            d = (1.0, -1.0, 0.0)
        up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(held, d) if x)
        down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(held, d) if x)
        # a martingale step: the expectation of pi does not change
        step = up if rand[at - 1] * (up + down) < down else -down
        for i, x in zip(held, d):
            pi[i] = min(1.0, max(0.0, pi[i] + step * x))
        held = [i for i in held if _EPS < pi[i] < 1 - _EPS]
        while len(held) < 3 and at < len(open_):
            held.append(open_[at])
            at += 1
    return np.where(pi < _EPS, 0.0, np.where(pi > 1 - _EPS, 1.0, pi))


def landing(pi: np.ndarray, size: np.ndarray, rand: np.ndarray) -> np.ndarray:
    """Settle the last open entries: drop the document constraint first and keep words
    (pairs trade expected words), then settle a single entry by its probability."""
    pi = pi.copy()
    while True:
        held = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))
        if len(held) == 0:
            return np.round(pi)
        if len(held) == 1 or not size[held[0]] or not size[held[1]]:
            i = held[0]
            pi[i] = 1.0 if rand[i] < pi[i] else 0.0
            continue
        a, b = held[:2]
        d = {a: float(size[b]), b: -float(size[a])}
        up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in d.items())
        down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in d.items())
        step = up if rand[a] * (up + down) < down else -down
        for i, x in d.items():
            pi[i] = min(1.0, max(0.0, pi[i] + step * x))


def _round(last: bool):
    def run(pdf):
        pdf = pdf.sort_values(["rank", "row"], kind="stable")
        pi, size, rand = (pdf[c].to_numpy() for c in ("pi", "size", "rand"))
        pi = flight(pi, size.astype(float), rand)
        if last:
            # another hash than the flight's, from the same place
            pi = landing(pi, size, np.modf(rand * 7919.0)[0])
        return pdf.assign(pi=pi)
    return run


def balanced_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, picked) of units (row, key, size, pi, rank, rand) with 0 <= pi <= 1, balanced
    within each key on the sums of pi and of pi * size."""
    settled = [units.filter((F.col("pi") <= _EPS) | (F.col("pi") >= 1 - _EPS))]
    open_ = units.filter((F.col("pi") > _EPS) & (F.col("pi") < 1 - _EPS))
    schema = units.schema
    while True:
        counts = open_.groupBy("key").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        last = most <= block
        # half-filled blocks on average, so that a hash rarely overfills one
        n = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / F.lit(block))).cast("long")
        if last:
            done = open_.groupBy("key").applyInPandas(_round(True), schema)
            settled.append(done)
            break
        parts = cut(open_.join(broadcast_checked(counts.select("key", n.alias("blocks")))[0], "key")
                    .withColumn("block", F.pmod(F.col("rank"), F.col("blocks"))).drop("blocks")
                    .groupBy("key", "block").applyInPandas(lambda pdf: _round(False)(pdf.drop(columns="block")), schema))
        settled.append(parts.filter((F.col("pi") <= _EPS) | (F.col("pi") >= 1 - _EPS)))
        # what is left is dealt anew: its hash moves on, blocks shrink with the level
        open_ = (parts.filter((F.col("pi") > _EPS) & (F.col("pi") < 1 - _EPS))
                 .withColumn("rank", F.xxhash64("rank")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("row", F.round("pi").cast("int").alias("picked"))


def mix_plan(df: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id",
             weights=WEIGHTS, max_ratio: float = MAX_RATIO, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One narrow row per row of ``df``: its key (see ``common.number_rows``), ``row_id``,
    ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    narrow = df.select(F.col(row_id).alias("row_id"), F.col(source).cast("string").alias("source"),
                       F.col(text).cast("string").alias("text"))
    narrow = narrow.withColumn("size", _words("text"))
    t = F.xxhash64("text")
    narrow = narrow.select("row_id", "size", F.struct(F.col("source").alias("v")).alias("key"),
                           F.struct(F.col("row_id").alias("c0"), F.col("source").alias("c1"), t.alias("t")).alias("at"))
    sized = cut(narrow.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy(F.lit(0))))
                .withColumn("row", F.monotonically_increasing_id()))
    sizes = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, max_ratio))
    # one row per source against all documents: broadcast where measured small
    with_target = sized.join(broadcast_checked(targets)[0], "key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + _EPS)
    h = F.xxhash64(F.lit(seed), F.col("row_id").cast("string"), F.col("at")["t"], F.col("nth"))
    units = with_target.select(
        "row", "key", "size", F.greatest(F.lit(0.0), ratio - whole).alias("pi"), h.alias("rank"),
        ((F.pmod(F.xxhash64(h, F.lit("rand")), F.lit(2 ** 52)) + 0.5) / F.lit(float(2 ** 52))).alias("rand"))
    return (with_target.join(balanced_sample(units, block), "row")
            .withColumn("copies", (whole + F.col("picked")).cast("int"))
            .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
            .drop("key", "row", "picked"))


RESULTS = ("size", "source_size", "target", "copies", "taken")


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", **kw) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` (the source's), ``copies`` and
    ``taken`` (words taken, repeats counted)."""
    df = df.drop(*RESULTS)
    key, nth = free_name(df, "at", "nth")
    plan = mix_plan(df, text, source, row_id, **kw)
    plan = plan.select(F.col("at").alias(key), F.col("nth").alias(nth), *RESULTS)
    return number_rows(df, row_id, source, text=text, key=key, nth=nth).join(plan, [key, nth]).drop(key, nth)


def take_mix(df: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", **kw) -> DataFrame:
    """The mix itself, with the columns of ``df``: each row as often as it is taken."""
    key, nth, copies = free_name(df, "at", "nth", "copies")
    plan = mix_plan(df, text, source, row_id, **kw)
    plan = plan.select(F.col("at").alias(key), F.col("nth").alias(nth), F.col("copies").alias(copies)).filter(F.col(copies) > 0)
    return (number_rows(df, row_id, source, text=text, key=key, nth=nth).join(plan, [key, nth])
            .withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(key, nth, copies))
