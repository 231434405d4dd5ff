"""Stress the scale paths on a table Spark derives from lineitem (COPIES stacked copies).

    python tools/stress_check.py [sf_dir] [copies]

Checks that nothing funnels a hot group into one task: dedup where three keys each
hold a third of the rows (both plans), the two-phase rank on a non-total order with
hot ties, a large-k threshold draw, density on a continuous column, the column
profile.  Prints one line per step with its wall time; writes nothing.
"""

from __future__ import annotations

import os
import sys
import time
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    from pyspark.sql import functions as F

    from seatwise.operators import density, first_per_key, ordinal, weighted_sample
    from seatwise.session import build_session
    from seatwise.sources.inspect import column_profile

    sf = argv[0] if argv else "/root/testdata/sf0.1"
    copies = int(argv[1]) if len(argv) > 1 else 10
    spark = build_session("local[8]", shuffle_partitions=32, extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    big = reduce(lambda a, b: a.unionByName(b), [li.withColumn("copy", F.lit(i)) for i in range(copies)])
    big = big.repartition(32)   # stand-in for a table of many files

    def step(name, fn):
        t = time.perf_counter()
        out = fn()
        print(f"{name}: {out} {time.perf_counter() - t:.1f}s", flush=True)

    ties = ["l_orderkey", "l_linenumber", "copy"]
    step("dedup_hot_keys_aggregate", lambda: first_per_key(big, "l_returnflag", "l_shipdate", ties).count())
    step("dedup_hot_keys_window",
         lambda: first_per_key(big, "l_returnflag", "l_shipdate", ties, method="window").count())
    step("rank_hot_ties", lambda: tuple(ordinal(big.select("l_returnflag", "l_orderkey"), ["l_returnflag"],
                                                name="r", method="range")
                                        .agg(F.max("r"), F.count_distinct("r")).first()))
    uid = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + F.col("copy")
    step("draw_threshold", lambda: weighted_sample(big.select(uid.alias("uid"), "l_quantity"),
                                                   li.count(), "uid", "l_quantity", seed=3,
                                                   strategy="threshold").count())
    step("density_continuous", lambda: density(big, "l_extendedprice", points=512).count())
    step("column_profile", lambda: column_profile(big).count())


if __name__ == "__main__":
    main(sys.argv[1:])
