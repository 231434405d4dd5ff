from pyspark.sql import functions as F

from seatwise.operators import sampling
from seatwise.operators.sizing import broadcast_checked, input_partitions
from seatwise.session import estimated_bytes
from tests.conftest import SF01


def test_estimate_follows_the_columns_read(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    assert estimated_bytes(o.select("o_orderkey")) < estimated_bytes(o)
    assert input_partitions(o) >= 1


def test_broadcast_checked(spark):
    n = spark.read.parquet(f"{SF01}/nation.parquet")
    _, ok = broadcast_checked(n)
    assert ok
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, ok_rows = broadcast_checked(n, max_rows=100)
        _, too_many = broadcast_checked(n, max_rows=10)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ok_rows and not too_many


def test_auto_draw_switches_plan_when_the_merge_would_grow(spark, monkeypatch):
    c = spark.read.parquet(f"{SF01}/customer.parquet")
    w = F.col("c_acctbal") + 1000.0
    topk = {r["c_custkey"] for r in sampling.weighted_sample(c, 50, "c_custkey", w, seed=3).collect()}
    monkeypatch.setattr(sampling, "TOPK_MERGE_ROWS", 0)
    big = sampling.weighted_sample(c, 50, "c_custkey", w, seed=3)
    p = big._jdf.queryExecution().executedPlan().toString()
    assert "LOG2" in p.upper()        # the histogram bucket filter ahead of any top-k
    assert {r["c_custkey"] for r in big.collect()} == topk


def test_scale_conf():
    from seatwise.session import scale_conf
    c = scale_conf(100 * 2**40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert scale_conf(10, 8)["spark.sql.shuffle.partitions"] == "24"


def test_a_wide_list_is_not_broadcast(spark):
    """Few rows and a small file, but long texts."""
    wide = spark.range(50).select(F.repeat(F.lit("x"), 100_000).alias("value"))
    _, ok = broadcast_checked(wide, max_bytes=1 << 20)
    assert not ok
    assert broadcast_checked(wide.limit(2), max_bytes=1 << 20)[1]


def test_shares_need_no_single_task(spark):
    from seatwise.operators.shares import share_of_total, share_within
    c = spark.read.parquet(f"{SF01}/customer.parquet").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    within, total = share_within(c, "c_mktsegment"), share_of_total(c)
    p = within._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in p and "SinglePartition" not in p and "Cartesian" not in p
    assert "Window" not in total._jdf.queryExecution().executedPlan().toString()
    assert abs(sum(r["p"] for r in total.collect()) - 1) < 1e-9
    assert abs(sum(r["p"] for r in within.collect()) - 5) < 1e-9
