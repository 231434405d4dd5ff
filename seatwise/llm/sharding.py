"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that must stay in one shard.  Groups are packed into
a given number of shards of the smallest fixed capacity that holds them: sorted by size,
each enters the open shard with the least remaining capacity that still takes it; the
remaining capacities are kept in a balanced search tree.

Every group goes through best fit, in levels, so that only a bounded number is packed in one
place.  First the groups are dealt over tasks of about ``PART`` groups, and each task packs
its own, in descending order, into boxes of ``1 / FINE`` of a mean shard; a larger group has
a box to itself.  While more than ``4 * FINE`` boxes a shard are left (a task's last box may
be half empty), the boxes are packed into further ones in the same way.  The last boxes are
packed into the shards.  The hash that deals groups over tasks decides no box: those are
each task's best fit.  Sizes and members are found by distributed aggregation.

A group larger than a mean shard cannot be split: the capacity grows to its size, it has
a shard to itself (best fit puts the rest elsewhere while it fits), and the other shards
stay near equal.

Defined results: a null text counts as an empty one (size 8).  Repeated rows are rows of
their own in the same group.  Rows without an id go after the others of their piece.  An
empty table gives no rows.  Other columns pass through; columns that have the names of
results are replaced.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup
from .common import cut, free_name, number_rows

ROW_COST = 8          # bytes counted for a row besides its text
FINE = 256            # boxes per shard, about
PART = 20_000         # groups or boxes packed by one task, about
MOST_SENT = 500_000   # boxes broadcast at most, some 20 MB; more are shuffled
PIECE = 50_000        # rows numbered together, about


class Tree:
    """Balanced search tree (a treap) of (remaining capacity, bin) with best-fit search."""

    def __init__(self):
        self._root, self._seed = None, 1

    def _priority(self) -> int:
        self._seed = self._seed * 6364136223846793005 + 1442695040888963407 & 2 ** 64 - 1
        return self._seed >> 20

    def _split(self, node, key):
        """Nodes below ``key`` and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._merge(a[3], b)
        return b[0], b[1], self._merge(a, b[2]), b[3]

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self._root, (room, bin_))
        self._root = self._merge(self._merge(low, ((room, bin_), self._priority(), None, None)), high)

    def take_best_fit(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, bin) with room >= size."""
        node, best = self._root, None
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, high = self._split(self._root, best)
            _, high = self._split(high, (best[0], best[1] + 1))
            self._root = self._merge(low, high)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Bin of each size (given in descending order) and the number of bins opened."""
    tree, where, bins = Tree(), [], 0
    for size in sizes:
        found = tree.take_best_fit(size)
        if found is None:
            found = (max(capacity, size), bins)
            bins += 1
        where.append(found[1])
        tree.add(found[0] - size, found[1])
    return where, bins


def pack(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing shards of the sizes (descending), with the least capacity, found
    by bisection, that needs no more than ``shards`` of them."""
    total = sum(sizes)
    low = max(-(-total // shards), max(sizes, default=0))
    high = max(2 * low, 1)
    while best_fit_decreasing(sizes, high)[1] > shards:
        high *= 2
    tried = range(low, high + 1, max(1, low // 4096))
    at = bisect.bisect_left(tried, True, key=lambda c: best_fit_decreasing(sizes, c)[1] <= shards)
    return best_fit_decreasing(sizes, tried[at] if at < len(tried) else high)[0]


def _boxes(items: DataFrame, n: int, capacity: int) -> DataFrame:
    """``items`` (item, size), ``n`` of them, with the ``box`` that best fit gives each.  A box's
    name depends on the items of its part alone, so a lost task packs again as before."""
    def pack_part(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        where, _ = best_fit_decreasing(part["size"].tolist(), capacity)
        name = str(part["part"].iloc[0]) + "."
        return pd.DataFrame({"item": part["item"], "size": part["size"], "box": [name + str(w) for w in where]})

    parts = max(1, -(-n // PART))
    dealt = items.select("item", "size", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part"))
    return cut(dealt.groupBy("part").applyInPandas(pack_part, "item string, size long, box string"))


def _place(groups: DataFrame, n: int, total: int, shards: int) -> DataFrame:
    """The ``shard`` of each of the ``n`` groups (item, size)."""
    capacity = max(1, -(-total // (FINE * shards)))
    levels = [_boxes(groups, n, capacity)]
    while True:
        # at most two boxes for each capacity's worth of bytes, and one more a part: a level with
        # more than the limit leaves fewer
        boxes = levels[-1].groupBy("box").agg(F.sum("size").alias("size")).withColumnRenamed("box", "item")
        n = boxes.count()
        if n <= 4 * FINE * shards:
            break
        levels.append(_boxes(boxes, n, capacity))
    last = sorted((-r["size"], r["item"]) for r in boxes.collect())      # at most 4 * FINE * shards
    where = pack([-s for s, _ in last], shards)
    rows = [(i, w) for (_, i), w in zip(last, where)]
    placed = groups.sparkSession.createDataFrame(rows, "box string, shard int")
    placed = F.broadcast(placed) if len(rows) <= MOST_SENT else placed
    for level in reversed(levels):
        placed = level.join(placed, "box").select("item", "shard")
        placed = placed if level is levels[0] else placed.withColumnRenamed("item", "box")
    return placed


def shard_plan(df: DataFrame, shards: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One narrow row per row of ``df``: its key (see ``common.number_rows``), ``row_id``,
    ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless in the shard)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.struct(F.col(row_id).alias("c0"), F.xxhash64(F.col(text).cast("string")).alias("t"))
    rows = cut(df.select(F.col(row_id).alias("row_id"), key.alias("at"),
                         (F.octet_length(body) + F.lit(ROW_COST)).cast("long").alias("size"),
                         F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.md5(F.encode(body, "UTF-8")).alias("group")))
    groups = rows.groupBy("group").agg(F.sum("size").alias("group_size"), F.count("*").alias("n"))
    groups = cut(groups)
    total, n_rows, n_groups = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    placed = _place(groups.select(F.col("group").alias("item"), F.col("group_size").alias("size")), n_groups, total, shards)
    placed = lookup(rows, "group", placed.withColumnRenamed("item", "group"))
    # slots: rows are numbered in pieces of bounded size, a shard's pieces one after another
    pieces = max(1, -(-n_rows // (PIECE * shards)))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("row_id", "text_crc32"), F.lit(pieces)).cast("int"))
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_piece = Window.partitionBy("shard", "piece").orderBy(F.col("row_id").asc_nulls_last(), "group")
    same = Window.partitionBy("at").orderBy(F.lit(0))
    return (placed.withColumn("slot", F.row_number().over(in_piece) - 1).join(starts, ["shard", "piece"])
            .withColumn("slot", (F.col("slot") + F.col("start")).cast("long"))
            .withColumn("nth", F.row_number().over(same))
            .select("row_id", "at", "nth", "size", "text_crc32", "shard", "slot"))


RESULTS = ("size", "text_crc32", "shard", "slot")


def shard(df: DataFrame, shards: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``df`` with ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    df = df.drop(*RESULTS)
    key, nth = free_name(df, "at", "nth")
    plan = shard_plan(df, shards, text, row_id).select(F.col("at").alias(key), F.col("nth").alias(nth), *RESULTS)
    return number_rows(df, row_id, text=text, key=key, nth=nth).join(plan, [key, nth]).drop(key, nth)
