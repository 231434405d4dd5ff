import numpy as np
from pyspark.sql import functions as F

from seatwise.operators.quantiles import exact_quantiles
from tests.conftest import SF01


def _xs(df, col):
    return df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())


def test_exact_quantiles_refine_to_numpy(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    xs = _xs(li, "l_extendedprice")
    x = np.array([r["x"] for r in xs.collect()])
    probs = [0.0, 0.25, 0.5, 0.75, 1.0, 0.3333]
    # a tiny collect bound forces several bucket passes
    got = exact_quantiles(xs, probs, max_collect=50, buckets=16)
    assert np.allclose(got, np.percentile(x, [p * 100 for p in probs]), rtol=0, atol=1e-9)


def test_exact_quantiles_with_a_hot_value(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0))
                                   .otherwise(F.col("id").cast("double")).alias("x"))
    x = np.array([r["x"] for r in df.collect()])
    got = exact_quantiles(df, [0.1, 0.25, 0.5, 0.9], max_collect=100, buckets=8)
    assert np.allclose(got, np.percentile(x, [10, 25, 50, 90]), rtol=0, atol=1e-9)


def test_all_quantiles_take_three_passes(spark, monkeypatch):
    passes = []
    xs = _xs(spark.read.parquet(f"{SF01}/lineitem.parquet"), "l_extendedprice")
    cls = type(xs)
    for name in ("first", "collect"):
        monkeypatch.setattr(cls, name, lambda self, *a, f=getattr(cls, name): (passes.append(1), f(self, *a))[1])
    exact_quantiles(xs, [0.1, 0.25, 0.5, 0.75, 0.9])
    # first() collects inside: an aggregate counts twice
    assert len(passes) <= 5


def test_density_leaves_out_what_is_not_finite(spark):
    from seatwise.operators.density import density
    good = spark.range(500).select((F.col("id") % 37).cast("double").alias("x"))
    bad = good.unionByName(spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double"))
    want = [tuple(r) for r in density(good, "x", points=64).orderBy("i").collect()]
    assert [tuple(r) for r in density(bad, "x", points=64).orderBy("i").collect()] == want


def test_density_of_many_points_needs_no_matrix(spark):
    from seatwise.operators.density import density
    xs = spark.range(300).select((F.col("id") % 41).cast("double").alias("x"))
    assert density(xs, "x", points=60_000).count() == 60_000
