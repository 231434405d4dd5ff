"""Count tables, report and charts from one scan; one rule for decoding."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from seatwise.operators import codebook as codebook_ops
from seatwise.operators.codebook import conformance, decode
from seatwise.operators.counts import count_by, count_tables
from seatwise.operators.lump import lump_counts, lump_top_n
from seatwise.plans import catalog, explore
from seatwise.plans.report import profile_report, report_counts
from seatwise.sources.codebook import codebook_df
from tests.conftest import SF01

ROWS = [("x", 1, "p"), ("x", None, "p"), (None, 1, "q"), (None, None, None), ("y", 2, "p"), ("x", 1, "p")]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_count_tables_are_the_single_counts(spark):
    df = spark.createDataFrame(ROWS, "a string, b int, c string")
    tables = {"by_a": ["a"], "by_b": ["b"], "again": ["a"], "pair": ["b", "c"], "all": []}
    out = count_tables(df, tables, {"most": F.max("b")}).collect()
    for t, keys in tables.items():
        want = Counter(tuple(dict(zip("abc", r))[k] for k in keys) for r in ROWS)
        got = {tuple(r[k] for k in keys): r.n for r in out if r["table"] == t}
        assert got == want
        assert all(r[k] is None for r in out if r["table"] == t for k in "abc" if k not in keys)
    assert [r.most for r in out if r["table"] == "all"] == [2]
    assert [tuple(r) for r in count_tables(df, {"all": []}).collect()] == [("all", 6)]


def test_one_scan(spark):
    assert scans(catalog.report_one_scan(spark, SF01)) == 1
    people = catalog._answers(spark.read.parquet(f"{SF01}/customer.parquet"))
    counts = report_counts(people)
    assert scans(counts) == 1
    report = profile_report(people)
    for t in ("by_gender", "by_country", "by_area", "mean_age", "all_answers"):
        assert scans(report[t]) == 0                      # read from the stored counts
    assert report["mean_age"].first()["mean"] is None     # an age is no number
    assert profile_report(people.limit(0))["mean_age"].collect()[0]["mean"] is None


def test_charts_from_shared_counts_are_those_alone(spark):
    datos = catalog._datos(spark, SF01).cache()
    together = explore.chart_tables(datos)
    alone = {"gender": explore.gender_share, "lgbt": explore.lgbt_share, "level": explore.level_count,
             "areas": explore.top_areas_share, "countries": explore.top_countries_share}
    for name, chart in alone.items():
        assert scans(together[name]) == 0
        assert sorted(map(str, together[name].collect())) == sorted(map(str, chart(datos).collect()))
        assert together[name].columns == chart(datos).columns


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 9])
def test_lumped_counts_are_counts_of_lumped_rows(spark, n):
    rows = [(v,) for v, k in (("a", 5), ("b", 3), ("c", 3), ("d", 1), ("e", 1), (None, 2)) for _ in range(k)]
    df = spark.createDataFrame(rows, "x string")
    want = {r.x: r.n for r in count_by(lump_top_n(df, "x", n, "other"), "x").collect()}
    got = {r.x: r.n for r in lump_counts(count_by(df, "x"), "x", n, "other").collect()}
    assert got == want


def test_decoding_has_one_rule(spark, monkeypatch):
    """Repeated codes and columns of numbers: the same rows on both sides of the limit."""
    book = codebook_df(spark, [("q", "mc", "Q", [("Uno", "1"), ("uno", "1"), ("Éuno", "1"), ("Dos", "2")]),
                               ("t", "mc", "T", [("Sí", "s"), ("No", "n")])])
    df = spark.createDataFrame([(1, "s"), (2, "x"), (3, None), (None, "n")], "q int, t string")
    small = sorted(map(str, decode(df, book).collect()))
    small_report = sorted(map(str, conformance(df, book, ["q"]).collect()))
    monkeypatch.setattr(codebook_ops, "MAX_LITERALS", 2)
    assert sorted(map(str, decode(df, book).collect())) == small
    assert sorted(map(str, conformance(df, book, ["q"]).collect())) == small_report
    labels = {r.q: r.q_label for r in decode(df, book).collect()}
    assert labels == {1: "Éuno", 2: "Dos", 3: None, None: None}
