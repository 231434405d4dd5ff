"""Links between members of buckets, and the components they form.

A bucket (an LSH band value, a prefix token) may hold a third of all members, so its
pairs are never made as rows.  A few leaders of each bucket are compared with its other
members; that settles most members of a large group.  ``group`` (components) then looks
for links between what is left in blocks of bounded size, by sketches, inside tasks.
Rounds of ever more leaders (``leads``) serve joins that only need one match a member.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release

FIRST = 8             # leaders of a bucket in the first round of a join
GROWTH = 16           # times as many in each round


def leads(round_: int, bucket: str = "bucket", id_: str = "id", n: str = "n") -> Column:
    """Whether a member is a new leader of a round: by hash, a share of
    ``FIRST * GROWTH ** round_ / n`` of the bucket without the earlier rounds' share."""
    place = F.pmod(F.xxhash64(bucket, id_), F.lit(2 ** 52)) / F.lit(float(2 ** 52)) * F.col(n)
    new = place < F.lit(float(FIRST * GROWTH ** round_))
    return new if round_ == 0 else new & (place >= F.lit(float(FIRST * GROWTH ** (round_ - 1))))


def in_buckets(members: DataFrame, *carried: str) -> DataFrame:
    """The members (bucket, id and the carried columns) of buckets of two or more, with the
    bucket's size ``n``."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return cut(members.join(sizes, "bucket").select("bucket", "id", "n", *carried))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of the ids that have edges; a component's name is its least id.
    Labels spread to the neighbours and then jump to the label's label, so the rounds grow
    with the logarithm of the longest path."""
    ends = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")),
                   F.struct(F.col(a).alias("x"), F.col(a).alias("y")), F.struct(F.col(b).alias("x"), F.col(b).alias("y")))
    both = cut(edges.select(F.explode(ends).alias("e")).select("e.x", "e.y").distinct())
    label = cut(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("component")))
    while True:
        step = (both.join(label.select(F.col("id").alias("y"), "component"), "y").groupBy(F.col("x").alias("id"))
                .agg(F.min("component").alias("new"), F.min(F.when(F.col("x") == F.col("y"), F.col("component"))).alias("old")))
        jump = label.select(F.col("id").alias("new"), F.col("component").alias("far"))
        label = cut(step.join(jump, "new").select("id", "old", F.least("new", "far").alias("component")))
        if label.filter("old != component").isEmpty():
            return label.select("id", "component")


LEADERS = 2           # leaders of a bucket by hash, besides the central one, in ``group``
BLOCK = 1024          # members of a bucket that are compared with another such block at once


def central(members: DataFrame) -> DataFrame:
    """(bucket, id) of the most central member of each bucket: the one that shares buckets
    with most others, as the original of a group of edited copies does."""
    crowd = members.groupBy("id").agg(F.sum("n").alias("crowd"))
    return (members.join(crowd, "id").groupBy("bucket").agg(F.max(F.struct("crowd", "id")).alias("m"))
            .select("bucket", F.col("m")["id"].alias("id")))


def close_in_blocks(members: DataFrame, alike) -> DataFrame:
    """Pairs (a, b), a < b, of members of one bucket and different components whose sketches
    are alike.  ``members``: bucket, id, n, component, sketch.

    A bucket is cut into blocks of about ``BLOCK`` members by hash, and every two blocks of
    it are compared in one row of bounded size; only pairs found alike become rows, and a
    pair that shares several buckets should be reported by ``alike`` in one of them."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BLOCK))).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
    one = F.struct(F.col("own").alias("k"), "id", "component", "sketch")
    pieces = (members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .groupBy("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
              .agg(F.collect_list(one).alias("m")).filter(F.size("m") > 1))
    return pieces.select(F.explode(alike("bucket", "lo", "hi", "m")).alias("p")).select("p.a", "p.b").distinct()


def group(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sketch: Callable[[DataFrame], DataFrame], alike) -> DataFrame:
    """(id, component) of the members that are linked.  ``members``: bucket, id, n, as
    ``in_buckets`` gives them.  ``verify`` gets pairs (a, b) with a < b and returns those
    that are links; ``sketch`` gets ids and returns them with a ``sketch``; ``alike`` is
    the column function that ``close_in_blocks`` uses."""
    lead = (members.filter(F.pmod(F.xxhash64("bucket", "id"), F.lit(2 ** 52)) / F.lit(float(2 ** 52)) * F.col("n") < LEADERS)
            .select("bucket", "id").unionByName(central(members)).distinct())
    pairs = (members.join(lead.select("bucket", F.col("id").alias("of")), "bucket").filter("id != of")
             .select(F.least("id", "of").alias("a"), F.greatest("id", "of").alias("b")).distinct())
    edges = cut(verify(pairs).select("a", "b"))
    label = components(edges)
    named = (members.join(label, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component")))
    # buckets in which not every pair has been compared and that are not one component yet
    mixed = (named.filter(F.col("n") > LEADERS).groupBy("bucket")
             .agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket"))
    open_ = cut(named.join(mixed, "bucket", "left_semi"))
    del lead, pairs, named, mixed
    release(members.sparkSession)
    sketched = sketch(open_.select("id").distinct())
    found = verify(close_in_blocks(open_.join(sketched, "id"), alike)).select("a", "b")
    return components(cut(edges.unionByName(found)))
