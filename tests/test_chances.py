"""Expected chances of the draw against simulated draws and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.operators import inclusion_chances


def chances(spark, weights, k, **how):
    df = spark.createDataFrame(list(enumerate(weights)), "id int, w double")
    out = inclusion_chances(df, k, "w", **how)
    assert out.columns == ["id", "w", "chance"]
    return [r.chance for r in out.orderBy("id").collect()]


def test_chances_agree_with_simulated_draws(spark):
    rng = np.random.default_rng(5)
    weights = rng.choice([0.5, 1, 2, 3, 5, 8, 40], 300)
    got = np.array(chances(spark, weights.tolist(), 40))
    keys = rng.exponential(size=(20_000, 300)) / weights
    drawn = np.zeros(300)
    for row in np.argpartition(keys, 40, axis=1)[:, :40]:
        drawn[row] += 1
    for w in set(weights.tolist()):      # rows of one weight share their chance
        same = weights == w
        assert np.ptp(got[same]) == 0 and abs(got[same][0] - drawn[same].mean() / 20_000) < 0.006
    assert abs(got.sum() - 40) < 1e-9


@pytest.mark.parametrize("weights,k", [([3.0] * 7, 2), ([1e-9, 1e9, 1.0, 1.0, 2.0], 3), ([1e-300, 1e-300, 2e-300], 1),
                                       (list(range(1, 200)), 198), ([1.0, 2.0], 1)])
def test_chances_sum_to_k(spark, weights, k):
    got = chances(spark, [float(w) for w in weights], k)
    assert math.isclose(sum(got), k, rel_tol=1e-9) and all(0 <= p <= 1 for p in got)
    assert all(p <= q for (v, p) in zip(weights, got) for (w, q) in zip(weights, got) if v <= w)
    if len(set(weights)) == 1:
        assert got == pytest.approx([k / len(weights)] * len(weights), rel=1e-12)


def test_rows_that_cannot_be_drawn(spark):
    assert chances(spark, [0.0, 1.0, 2.0], 2) == [0.0, 1.0, 1.0]
    assert chances(spark, [0.0, 1.0, 2.0], 5) == [0.0, 1.0, 1.0]
    assert chances(spark, [0.0, 1.0, 2.0], 0) == [0.0, 0.0, 0.0]
    odd = [None, float("nan"), float("inf"), -1.0, 1.0]
    assert chances(spark, odd, 1, null_weight="skip", negative_weight="skip") == [0.0] * 4 + [1.0]
    for bad in ([None, 1.0], [float("nan"), 1.0], [-1.0, 1.0]):
        with pytest.raises(Exception, match="weight in weighted_sample"):
            chances(spark, bad, 1)
    with pytest.raises(ValueError):
        chances(spark, [1.0], -1)
    empty = spark.createDataFrame([], "id int, w double")
    assert inclusion_chances(empty, 3, "w").count() == 0
    even = inclusion_chances(spark.range(8).withColumn("w", F.lit("x")), 2)
    assert [r.chance for r in even.collect()] == pytest.approx([0.25] * 8, rel=1e-12)
