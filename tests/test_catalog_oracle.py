"""Every catalogue query against its SQL in DuckDB at sf0.01 (the driver's gate)."""

import pytest

from tests.conftest import SF01


@pytest.fixture(scope="module")
def con():
    from tools.oracle_check import duck
    return duck(SF01)


def _names():
    from seatwise.plans.catalog import QUERIES
    return list(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    from tools.oracle_check import compare
    ok, msg = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF01)
    assert ok, msg


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert len(rows) > 0 and set(rows[0].asDict()) == {"c_mktsegment", "n", "p"}


def test_entry_matches_sql_at_sf0001(spark):
    from __spark_entry__ import entry
    from seatwise.plans.catalog import SEATS, SQL_ADMITTED
    from tools.oracle_check import duck
    con = duck("/root/testdata/sf0.001")
    sql = ("WITH " + SQL_ADMITTED.replace(f"LIMIT {SEATS}", "LIMIT 40") +
           " SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p"
           " FROM admitted GROUP BY c_mktsegment")
    want = sorted(con.execute(sql).fetchall())
    got = sorted(tuple(r) for r in entry(spark).select("c_mktsegment", "n", "p").collect())
    assert got == want


ORDER_SENSITIVE = ["flagship_seat_draw", "weighted_sample", "weighted_sample_threshold", "first_submission",
                   "first_submission_window", "ordinal_rank", "score_rules", "recipient_list",
                   "lump_top_n", "category_order", "sort_text_number", "clean_intake"]


@pytest.mark.parametrize("name", ORDER_SENSITIVE)
def test_same_rows_with_other_partitioning(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    from tools.oracle_check import compare
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ok, msg = compare(spark, con, name, queries()[name], oracle_sql()[name], SF01)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ok, msg
