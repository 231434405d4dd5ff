"""Merkle dataset manifest: one hash for a dataset, and a proof for each of its rows.

A row's leaf is the SHA-256 of its fields, each with its length.  Within a group the leaves
stand in order; runs of ``FANOUT`` consecutive nodes become their parent until one node, the
group's subroot, remains.  The subroots become the root in the same way.

The slot pivot: a node's place modulo ``FANOUT`` is its slot.  One grouped aggregate per level
spreads the children of each parent into ``FANOUT`` columns (a conditional aggregate per
slot); the concatenated columns are the parent's input, and the columns without a node's own
are its siblings.  Levels shrink by the fanout and are cut, so that the way down (the
siblings of a node, then those of its parent, ...) reads them again.  Hashes travel as 32
bytes and are hex text only inside a hash.  A row's way to the root is never shuffled as a
row of its own: a leaf meets its parent's columns and way in the last join.

Places come from the global two-phase ordinal, so a group that holds a third of the rows is
spread over many tasks.

Defined results: a null field is ``-``; a null text has the leaf of that; rows of equal order
value stand by their leaf (equal leaves are interchangeable), null order values last.  The
null group comes first.  An empty table has no rows and no root.  Columns that are not among
the fields do not matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import ordinal
from ..operators.sizing import broadcast_checked
from .common import cut

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WAY = "array<struct<before:binary,after:binary>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(h: Column) -> Column:
    return F.lower(F.hex(h))


def leaf_of(fields: list[Column]) -> Column:
    """The leaf of a row: each field is ``-`` if null, else its bytes' number, ``:``, itself."""
    parts = []
    for f in fields:
        f = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")))
    return digest(*parts)


def tampered_leaf(fields: list[str], text: str = "text") -> Column:
    """The leaf after the text's A-Z have been lower-cased."""
    return leaf_of([F.translate(F.col(f), UPPER, LOWER) if f == text else F.col(f) for f in fields])


def _slots(fanout: int) -> list[str]:
    return [f"s{k}" for k in range(fanout)]


def parents_of(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(g, pos, n, h, s0, s1, ...) of the parents of nodes (g, pos, n, h); ``n`` counts the
    nodes of the group's level.  A group of one node is finished and has none."""
    slot = F.pmod(F.col("pos"), F.lit(fanout))
    spread = [F.max(F.when(slot == k, F.col("h"))).alias(s) for k, s in enumerate(_slots(fanout))]
    out = (nodes.filter("n > 1").groupBy("g", F.floor(F.col("pos") / fanout).cast("long").alias("pos"), "n").agg(*spread)
           .withColumn("n", F.ceil(F.col("n") / fanout).cast("long")))
    return out.withColumn("h", digest(F.concat_ws("", *[as_text(F.col(s)) for s in _slots(fanout)])))


def build(nodes: DataFrame, most: int, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels of parents above nodes (g, pos, n, h) and each group's (g, h) at the top.
    ``most``: nodes of the largest group."""
    levels, tops = [], nodes.filter("n = 1").select("g", "h")
    while most > 1:
        levels.append(cut(parents_of(nodes, fanout)))
        nodes = levels[-1]
        tops = tops.unionByName(nodes.filter("n = 1").select("g", "h"))
        most = -(-most // fanout)
    return levels, tops


def _siblings(slot: Column, fanout: int) -> Column:
    """What stands before and after a slot among the columns of a parent."""
    empty = F.lit(b"")
    one = [F.coalesce(F.col(s), empty) for s in _slots(fanout)]
    before = F.concat(*[F.when(slot > k, c).otherwise(empty) for k, c in enumerate(one)])
    after = F.concat(*[F.when(slot < k, c).otherwise(empty) for k, c in enumerate(one)])
    return F.struct(before.alias("before"), after.alias("after"))


def with_ways(nodes: DataFrame, levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``nodes`` (g, pos and more) with ``way``: the siblings of the node, of its parent and so
    on below the group's top."""
    none = F.array().cast(WAY)
    if not levels:
        return nodes.withColumn("way", none)
    below = None
    for parents in reversed(levels):
        at = parents.drop("h", "n")
        if below is not None:
            at = at.join(below, ["g", "pos"], "left")
        else:
            at = at.withColumn("way", none)
        at = at.withColumn("way", F.coalesce("way", none))
        if parents is levels[0]:
            break
        children = F.array(*[F.when(F.col(s).isNotNull(), F.struct((F.col("pos") * fanout + k).alias("pos"),
                             F.concat(F.array(_siblings(F.lit(k), fanout)), F.col("way")).alias("way")))
                             for k, s in enumerate(_slots(fanout))])
        below = at.select("g", F.explode(F.array_compact(children)).alias("c")).select("g", "c.pos", "c.way")
    at = at.withColumnRenamed("pos", "__parent").withColumnRenamed("way", "__way")
    slot = F.pmod(F.col("pos"), F.lit(fanout))
    own = F.concat(F.array(_siblings(slot, fanout)), F.col("__way"))
    joined = nodes.withColumn("__parent", F.floor(F.col("pos") / fanout).cast("long")).join(at, ["g", "__parent"], "left")
    return joined.withColumn("way", F.when(F.col("__way").isNotNull(), own).otherwise(none)).select(*nodes.columns, "way")


def fold(leaf: Column, way: Column) -> Column:
    """The root that a leaf (32 bytes) and its way lead to, as text."""
    return F.aggregate(way, as_text(leaf), lambda h, s: F.sha2(F.concat(as_text(s["before"]), h, as_text(s["after"])), 256))


def proof_digest(way: Column) -> Column:
    """SHA-256 of the way: all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda s: as_text(F.concat(s["before"], s["after"]))), ""), 256)


@dataclass
class Manifest:
    """``leaves``: one row per row of the dataset (id, group, leaf, the kept columns, subroot and
    ``way``); ``groups``: (grp, n, subroot); ``levels``: the parents below the subroots, lowest
    first; ``root``: text, None for an empty dataset."""

    leaves: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    root: str | None


def manifest(docs: DataFrame, fields=FIELDS, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None,
             fanout: int = FANOUT) -> Manifest:
    """The manifest of a dataset.  ``keep``: further columns of the leaves, made of the
    columns of ``docs`` in the one pass that reads the texts."""
    keep = keep or {}
    hashed = cut(docs.select(F.col(order).alias("id"), F.col(group).cast("string").alias("grp"),
                             leaf_of([F.col(f) for f in fields]).alias("h"), *[c.alias(k) for k, c in keep.items()]))
    placed = ordinal(hashed, ["grp", "id", "h"], name="at", method="range")
    size = placed.groupBy("grp").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    size = size.withColumn("named", F.col("grp").isNotNull().cast("int"))
    groups = cut(ordinal(size, ["named", "grp"], name="g").select("grp", "g", "lo", "n"))
    most, number = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    if not number:
        return Manifest(hashed.withColumns({"subroot": F.lit(None).cast("string"), "way": F.array().cast(WAY)}).withColumnRenamed("h", "leaf"),
                        groups.select("grp", "n", F.lit(None).cast("string").alias("subroot")), [], None)
    small = broadcast_checked(groups)[0].withColumnRenamed("grp", "__grp")
    leaves = (placed.join(small, F.col("grp").eqNullSafe(F.col("__grp")))
              .withColumn("pos", F.col("at") - F.col("lo")).drop("at", "lo", "__grp"))
    levels, tops = build(leaves.select("g", "pos", "n", "h"), most, fanout)
    tops = cut(tops)
    above = tops.select(F.lit(0).cast("long").alias("g"), (F.col("g") - 1).alias("pos"), F.lit(number).cast("long").alias("n"), "h")
    upper, root = build(above, number, fanout)
    subroots = cut(with_ways(above, upper, fanout).select((F.col("pos") + 1).alias("g"), F.col("h").alias("subroot"), F.col("way").alias("above")))
    rows = with_ways(leaves, levels, fanout).join(broadcast_checked(subroots)[0], "g")
    rows = rows.select("id", "grp", F.col("h").alias("leaf"), *keep, as_text(F.col("subroot")).alias("subroot"),
                       F.concat("way", "above").alias("way"))
    named = groups.join(subroots, "g").select("grp", "n", as_text(F.col("subroot")).alias("subroot"))
    return Manifest(rows, named, levels, bytes(root.first()["h"]).hex())


def verify(rows: DataFrame, root: str | None, leaf: str = "leaf", way: str = "way") -> DataFrame:
    """``rows`` with ``folded_root``, which leaf and way lead to, and ``verified``: whether that
    is the root."""
    out = rows.withColumn("folded_root", fold(F.col(leaf), F.col(way)))
    return out.withColumn("verified", F.col("folded_root") == F.lit(root))
