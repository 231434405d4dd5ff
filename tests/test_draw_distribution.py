"""The hash-keyed draw has the distribution of sequential weighted sampling without
replacement (draw one at a time with chance proportional to the remaining weights).

20,000 independent draws run as ONE job: the seed is a column, the k smallest keys
per seed are kept with a window, inclusion rates are compared with the exact
probabilities computed by enumerating every draw order."""

from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seatwise.operators.sampling import sampling_key

WEIGHTS = {1: 1.0, 2: 2.0, 3: 3.0, 4: 5.0, 5: 8.0, 6: 1.0}
K, SEEDS = 3, 20_000


def exact_inclusion(weights, k):
    items = list(weights)
    p = dict.fromkeys(items, 0.0)
    for order in permutations(items, k):
        prob, left = 1.0, sum(weights.values())
        for it in order:
            prob *= weights[it] / left
            left -= weights[it]
        for it in order:
            p[it] += prob
    return p


def test_inclusion_rates_match_sequential_sampling(spark):
    n = len(WEIGHTS)
    w = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    rows = (spark.range(SEEDS * n)
            .select((F.col("id") / n).cast("long").alias("seed"), (F.col("id") % n + 1).alias("item"))
            .withColumn("w", F.element_at(w, F.col("item"))))
    keyed = rows.withColumn("key", sampling_key("item", F.col("w"), F.col("seed")))
    top = keyed.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("key", "item")))
    got = {r["item"]: r["c"] / SEEDS for r in
           top.filter(F.col("r") <= K).groupBy("item").agg(F.count(F.lit(1)).alias("c")).collect()}
    want = exact_inclusion(WEIGHTS, K)
    assert abs(sum(want.values()) - K) < 1e-9
    for it in WEIGHTS:
        assert abs(got[it] - want[it]) < 0.015, (it, got[it], want[it])
