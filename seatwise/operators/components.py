"""Connected components of values that occur together.

Two values are linked when a row holds both (a name and an e-mail); the components of these
links say which values belong to one person.  Labels spread to the neighbours and then jump
to the label's label, so the rounds grow with the logarithm of the longest chain.  A value
that a third of the links has never meets them in one task: minima are partial aggregates and
every join takes hot values out first (``skew.lookup``).  Each round is a checkpoint, so a
lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.operators.skew import LEAST_ROWS, lookup
from seatwise.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b", least_hot: int = LEAST_ROWS) -> DataFrame:
    """(node, component) of the values in columns ``a`` and ``b`` of ``links``, which are of one
    type; a component's name is its least value.  A row with a null links nothing; its other
    value is a component of its own unless other rows link it."""
    x, y = F.coalesce(F.col(a), F.col(b)).alias("x"), F.coalesce(F.col(b), F.col(a)).alias("y")
    pairs = links.select(x, y).filter(F.col("x").isNotNull()).distinct()
    way = lambda p, q: F.struct(F.col(p).alias("x"), F.col(q).alias("y"))
    both = stored(pairs.select(F.explode(F.array(way("x", "y"), way("y", "x"), way("x", "x"), way("y", "y"))).alias("e"))
                  .select("e.x", "e.y").distinct())
    label = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("component")))
    while True:
        of_y = label.select(F.col("node").alias("y"), "component")
        seen = lookup(both, "y", of_y, how="inner", least=least_hot)
        # a node is its own neighbour, so its present label is among them
        step = stored(seen.groupBy("x").agg(F.min("component").alias("new"),
                                            F.min(F.when(F.col("x") == F.col("y"), F.col("component"))).alias("old")))
        far = label.select(F.col("node").alias("new"), F.col("component").alias("far"))
        label = stored(lookup(step, "new", far, how="inner", least=least_hot)
                       .select(F.col("x").alias("node"), "old", F.least("new", "far").alias("component")))
        if label.filter("old <> component").isEmpty():
            return label.select("node", "component")
