"""The coverage table names every registered query, and every query has SQL."""

import os

from seatwise.plans.catalog import ORACLE_SQL, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_is_in_the_coverage_table():
    cov = open(os.path.join(ROOT, "COVERAGE.md")).read()
    assert [q for q in QUERIES if f"`{q}`" not in cov] == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
