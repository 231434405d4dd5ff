"""Profiles that merge, observed intakes, bucketed snapshots and thinned semi-joins."""

import uuid

import pytest
from pyspark.sql import functions as F

from seatwise.operators.bitmaps import bits_for, possible_members
from seatwise.operators.dedup import first_per_key
from seatwise.operators.membership import in_list
from seatwise.plans.config import IntakeConfig
from seatwise.plans.intake import clean_intake
from seatwise.plans.observed import Steps, write_observed_intake
from seatwise.session import scratch_path
from seatwise.sources.buckets import register_buckets, write_bucketed
from seatwise.sources.codebook import REQUIRED, codebook_df
from seatwise.sources.profile import build_profile, merge_profiles, read_profile
from seatwise.operators.codebook import conformance
from tests.conftest import SF01
from tests.fixtures import responses


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


EXACT = ["column", "n", "n_non_null", "least", "greatest", "least_number", "greatest_number"]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_two_snapshots_merge_to_the_profile_of_their_union(spark):
    e = spark.read.parquet(f"{SF01}/events.parquet").withColumn("value", F.when(F.col("value") > 1, F.col("value")))
    a, b = e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0")
    merged = merge_profiles(build_profile(a).unionByName(build_profile(b)))
    whole = build_profile(e)
    assert rows(merged, *EXACT) == rows(whole, *EXACT)
    exact = {c: e.select(F.count_distinct(f"`{c}`")).first()[0] for c in e.columns}
    for report in (read_profile(merged), read_profile(whole)):
        for r in report.collect():
            assert abs(r.n_distinct - exact[r.column]) <= max(1, 0.04 * exact[r.column]), r      # five standard errors
            if r.quantiles is None:
                continue
            n = e.filter(F.col(r.column).isNotNull()).count()
            for p, q in zip((0.25, 0.5, 0.75), r.quantiles):
                assert e.filter(F.col(r.column) < q).count() <= (p + 0.015) * n
                assert e.filter(F.col(r.column) <= q).count() >= (p - 0.015) * n


def test_profile_of_odd_tables(spark):
    schema = "`a.b` string, x double, d date"
    empty = read_profile(build_profile(spark.createDataFrame([], schema)))
    assert rows(empty, "column", "n", "n_non_null", "n_distinct", "quantiles") == [(c, 0, 0, 0, None) for c in ("a.b", "d", "x")]
    odd = spark.createDataFrame([(None, float("nan"), None), ("", None, None), ("z" * 100_000, 2.0, None)], schema)
    twice = merge_profiles(build_profile(odd).unionByName(build_profile(odd)))
    got = {r.column: r for r in read_profile(twice, [0.5]).collect()}
    assert (got["a.b"].n, got["a.b"].n_non_null, got["a.b"].n_distinct, got["a.b"].least) == (6, 4, 2, "")
    assert (got["x"].n_non_null, got["x"].n_distinct, got["x"].quantiles, got["x"].least_number) == (4, 2, [2.0], 2.0)
    assert (got["d"].n_non_null, got["d"].n_distinct, got["d"].quantiles) == (0, 0, None)


def test_a_profile_reads_the_rows_once_and_makes_no_row_a_cell(spark):
    p = plan(build_profile(spark.read.parquet(f"{SF01}/orders.parquet")))
    assert p.count("Scan parquet") == 1
    assert p.index("Generate") < p.index("partial_count")      # above the aggregate


@pytest.mark.parametrize("identity", ["name", "linked"])
def test_observed_intake_counts_what_each_step_keeps(spark, identity):
    raw = responses(spark).repartition(3)
    cfg = IntakeConfig(exclude_names=("Prueba Interna",), cutoff="2026-06-14 00:00:00", identity=identity)
    path, book = scratch_path(spark, "observed"), codebook_df(spark)
    account, report = write_observed_intake(raw, path, cfg, book, REQUIRED)
    clean = clean_intake(raw, cfg)
    steps = {r.step: r.n for r in account.collect()}
    assert steps["read"] == raw.count()
    assert steps["e-mail present"] == raw.filter("correo is not null").count()
    assert steps["test names out"] == raw.filter("correo is not null and nombre <> 'Prueba Interna'").count()
    assert steps["valid and in time"] == clean.count() == spark.read.parquet(path).count()
    assert rows(report, *report.columns) == rows(conformance(clean, book, REQUIRED), *report.columns)
    assert not {"nombre", "correo"} & set(spark.read.parquet(path).columns)


def test_observed_intake_of_no_rows(spark):
    raw = responses(spark).filter("false")
    account, report = write_observed_intake(raw, scratch_path(spark, "observed"), None, codebook_df(spark), REQUIRED)
    assert {r.n for r in account.collect()} == {0}
    assert {(r.n, r.n_missing, r.n_out_of_domain) for r in report.collect()} == {(0, 0, 0)}


def test_observed_intake_that_keeps_no_row(spark):
    raw = responses(spark).withColumn("correo", F.lit("no mail"))
    account, report = write_observed_intake(raw, scratch_path(spark, "observed"), None, codebook_df(spark), REQUIRED)
    n = {r.step: r.n for r in account.collect()}
    assert n["read"] == n["e-mail present"] == raw.count() and n["valid and in time"] == 0 < n["first of a person"]
    none = responses(spark).withColumn("correo", F.lit(None).cast("string"))
    account, _ = write_observed_intake(none, scratch_path(spark, "observed"))
    assert [(r.n, r.n_lost) for r in account.collect()][:2] == [(raw.count(), 0), (0, raw.count())]


def test_an_observed_intake_scans_once(spark):
    raw = spark.read.parquet(f"{SF01}/events.parquet").select(
        F.concat(F.lit("u"), "user_id").alias("nombre"), F.lit("a@b.c").alias("correo"), F.col("ts").cast("string").alias("time_end"))
    p = plan(clean_intake(raw, IntakeConfig(), Steps().mark))
    assert p.count("Scan parquet") == 1 and p.count("CollectMetrics") >= 5


def test_buckets_spare_the_shuffle_of_semi_join_and_dedup(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey")
    keys = spark.read.parquet(f"{SF01}/customer.parquet").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    path, name = scratch_path(spark, "orders"), f"orders_{uuid.uuid4().hex}"
    a = write_bucketed(o, name, path, "o_custkey", 8, ["o_orderdate", "o_orderkey"])
    b = write_bucketed(keys, f"keys_{uuid.uuid4().hex}", scratch_path(spark, "keys"), "o_custkey", 8)
    first = lambda x, k: first_per_key(x.join(k.hint("merge"), "o_custkey", "left_semi"), "o_custkey", "o_orderdate", "o_orderkey")
    assert "Exchange" not in plan(first(a, b))
    assert "Exchange" in plan(first(o, keys))
    assert rows(first(a, b), *o.columns) == rows(first(o, keys), *o.columns)
    again = register_buckets(spark, f"again_{uuid.uuid4().hex}", path, "o_custkey", 8, ["o_orderdate", "o_orderkey"])
    assert "Exchange" not in plan(first(again, b))
    assert rows(again, *o.columns) == rows(o, *o.columns)


def test_a_bitmap_thins_the_shuffled_side_and_keeps_the_rows(spark):
    lines = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.lit(1).alias("a.b"))
    keys = spark.read.parquet(f"{SF01}/orders.parquet").filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("value"))
    thin = in_list(lines, "l_orderkey", keys, max_broadcast_rows=0)
    plain = in_list(lines, "l_orderkey", keys, max_broadcast_rows=0, thin=False)
    cols = ["l_orderkey", "l_linenumber", "`a.b`"]
    assert rows(thin, *cols) == rows(plain, *cols) and thin.columns == plain.columns
    distinct = keys.select(F.col("value").alias("l_orderkey")).distinct()
    left = possible_members(lines, "l_orderkey", distinct, distinct.count())
    n, members = lines.count(), plain.count()
    assert members <= left.count() <= members + 2 * n // 16
    assert "bitmap_construct_agg" in plan(left) and "ArrowEvalPython" not in plan(left)


def test_a_thinned_join_of_odd_keys(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 3), ("b", 4), ("ñ" * 50_000, 5)], "k string, v int")
    some = spark.createDataFrame([(None,), ("",), ("a",), ("a",), ("ñ" * 50_000,)], "value string")
    assert rows(in_list(df, "k", some, max_broadcast_rows=0), "v") == [(2,), (3,), (3,), (5,)]
    assert in_list(df, "k", some.filter("false"), max_broadcast_rows=0).count() == 0
    numbers = spark.createDataFrame([(3,), (9,)], "value bigint")       # another type of number: the join casts, the hash would not
    assert rows(in_list(df, "v", numbers, max_broadcast_rows=0), "v") == [(3,), (3,)]
    assert bits_for(0) == bits_for(2048) == 1 << 15 and bits_for(2049) == 1 << 16
