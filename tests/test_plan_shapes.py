"""Physical-plan checks: the plan we want, not only the rows."""

from pyspark.sql import functions as F

from seatwise.operators import ordinal, weighted_sample
from seatwise.operators.dedup import first_per_key
from tests.conftest import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_draw_is_take_ordered(spark):
    c = spark.read.parquet(f"{SF01}/customer.parquet")
    p = plan(weighted_sample(c, 160, "c_custkey", None, seed=1, on_short="all"))
    assert "TakeOrderedAndProject" in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_range_ordinal_has_no_single_partition(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    p = plan(ordinal(o, ["-o_totalprice", "o_orderkey"], method="range"))
    assert "SinglePartition" not in p
    assert "SinglePartition" in plan(ordinal(o, ["-o_totalprice", "o_orderkey"], method="window"))


def test_auto_ordinal_follows_the_size_estimate(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    small = plan(ordinal(o, ["-o_totalprice", "o_orderkey"]))
    assert "SinglePartition" in small                      # 15k rows: one task is fine
    big = plan(ordinal(o, ["-o_totalprice", "o_orderkey"], single_task_bytes=0))
    assert "SinglePartition" not in big


def test_dedup_aggregates_before_the_shuffle(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    p = plan(first_per_key(o, "o_custkey", "o_orderdate", "o_orderkey", method="aggregate"))
    assert p.index("partial_min_by") > p.index("Exchange hashpartitioning")   # below the exchange
    w = plan(first_per_key(o, "o_custkey", "o_orderdate", "o_orderkey", method="window"))
    assert "row_number(), 1, Partial" in w and w.index("Partial") > w.index("Exchange hashpartitioning")


def test_cutoff_pushed_and_columns_pruned(spark):
    e = spark.read.parquet(f"{SF01}/events.parquet")
    df = e.filter(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


def test_no_python_udfs_in_catalogue(spark):
    from seatwise.plans.catalog import QUERIES
    for name in ["flagship_seat_draw", "clean_intake", "density", "lump_top_n", "conformance"]:
        p = plan(QUERIES[name](spark, SF01))
        assert "EvalPython" not in p, name


def test_membership_filter_reaches_the_scan(spark):
    from seatwise.functions import keep_in
    c = spark.read.parquet(f"{SF01}/customer.parquet")
    p = plan(keep_in(c, "c_mktsegment", ["BUILDING", "FURNITURE"]).select("c_custkey"))
    assert "PushedFilters: [In(c_mktsegment" in p or "PushedFilters: [IsNotNull(c_mktsegment), In(c_mktsegment" in p


def test_clean_intake_pushes_row_filters_to_the_scan(spark, scratch):
    from seatwise.plans.config import IntakeConfig
    from seatwise.plans.intake import clean_intake
    from seatwise.sources import read_parquet, response_schema
    from tests.fixtures import TEST_NAME, responses
    path = f"{scratch}/resp"
    responses(spark).write.parquet(path)
    raw = read_parquet(spark, path, schema=response_schema())
    p = plan(clean_intake(raw, IntakeConfig(exclude_names=(TEST_NAME,))))
    assert "IsNotNull(correo)" in p and f"Not(EqualTo(nombre,{TEST_NAME}))" in p
    assert "time_start" not in p.split("ReadSchema:")[1].split("\n")[0]    # dropped column not read


def test_no_query_pairs_rows_or_runs_python(spark):
    """Across the whole catalogue: no Cartesian product, no nested-loop join (a cross
    join in disguise), no Python evaluation."""
    from seatwise.plans.catalog import QUERIES
    bad = {}
    for name, fn in QUERIES.items():
        p = plan(fn(spark, SF01))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython") if k in p]
        if hits:
            bad[name] = hits
    assert bad == {}
