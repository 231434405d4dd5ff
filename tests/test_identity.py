"""Linked identity: components of names and e-mails, and lookups with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from seatwise.operators.components import components
from seatwise.operators.skew import hot_keys, lookup
from seatwise.plans.config import IntakeConfig
from seatwise.plans.intake import clean_intake
from seatwise.streaming import first_submissions


def union_find(pairs):
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v
    for a, b in pairs:
        a, b = a if a is not None else b, b if b is not None else a
        if a is not None:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {v: top(v) for v in up}


def test_components_are_those_of_union_find(spark):
    rng = random.Random(4)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]               # a long path
    star = [("hub", f"s{i}") for i in range(400)]                              # a hub
    some = [(f"r{rng.randrange(150)}", f"q{rng.randrange(150)}") for _ in range(120)]
    odd = [(None, None), ("alone", None), (None, "other"), ("x", "x"), ("hub", "s1")]
    pairs = chain + star + some + odd
    df = spark.createDataFrame(pairs, "a string, b string").repartition(5)
    want = union_find(pairs)
    for least in (10_000, 50):                                                 # without and with hot values
        got = {r.node: r.component for r in components(df, least_hot=least).collect()}
        assert got == want
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_a_join(spark, how):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 500 + ["a", "b", "missing", None] * 5)], "k string, v int")
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("unused", 4)], "k string, w int")
    want = sorted(map(tuple, rows.join(table, "k", how).select("k", "v", "w").collect()), key=repr)
    assert [r.k for r in hot_keys(rows, "k", 100).collect()] == ["hot"]
    for least in (100, 10_000):
        assert sorted(map(tuple, lookup(rows, "k", table, how, least).select("k", "v", "w").collect()), key=repr) == want


ROWS = [  # name, e-mail, time, session
    ("Ana  Ruiz", "ana@x.cl", "2026-01-03 00:00:00", 1),
    ("ana ruíz", "ANA@x.cl", "2026-01-01 00:00:00", 2),       # another spelling, the same address: the first
    ("ana ruíz", "ana@work.cl", "2026-01-02 00:00:00", 3),    # linked by the second spelling
    ("A. Ruiz", "ana@work.cl", None, 4),                      # and by that address
    ("Luz", "-", "2026-01-01 00:00:00", 5),                   # her first answer has no valid address
    ("Luz", "luz@x.cl", "2026-01-04 00:00:00", 6),
    ("Eva", "-", "2026-01-05 00:00:00", 7),                   # shares only "-"
    (None, "nn@x.cl", "2026-01-01 00:00:00", 8),
    (None, "mm@x.cl", "2026-01-01 00:00:00", 9),              # null names link nothing
    (" ", "oo@x.cl", "2026-01-01 00:00:00", 10),
    (None, "-", "2026-01-01 00:00:00", 11),
    ("Sol", "sol@x.cl", "2026-01-02 00:00:00", 13),
    ("Sol", "sol@x.cl", "2026-01-02 00:00:00", 12),           # a tie: the lower session
]


def people(spark, **cfg):
    df = spark.createDataFrame(ROWS, "nombre string, correo string, time_end string, session_id int")
    return sorted(r.session_id for r in clean_intake(df, IntakeConfig(identity="linked", keep_session=True, **cfg)).collect())


def test_linked_people(spark):
    assert people(spark) == [2, 8, 9, 10, 12]
    assert people(spark, validate_before_dedup=True) == [2, 6, 8, 9, 10, 12]
    assert people(spark, dedup_method="aggregate") == [2, 8, 9, 10, 12]


def test_linked_identity_refuses_what_contradicts_it(spark):
    df = spark.createDataFrame(ROWS, "nombre string, correo string, time_end string, session_id int")
    with pytest.raises(ValueError):
        clean_intake(df, IntakeConfig(identity="linked", dedup_extra_keys=("correo",)))
    with pytest.raises(ValueError):
        clean_intake(df, IntakeConfig(identity="other"))
    with pytest.raises(ValueError):
        first_submissions(df, IntakeConfig(identity="linked"))


def test_a_hot_name_is_one_row_per_task_and_address(spark):
    """A name that most rows have is cut down before the shuffle: the first plan has the partial limit."""
    df = spark.range(20_000).select(F.lit("Hot").alias("nombre"), F.concat((F.col("id") % 7).cast("string"), F.lit("@x.cl")).alias("correo"),
                                    F.lit("2026-01-01 00:00:00").alias("time_end"), F.col("id").alias("session_id"))
    out = clean_intake(df, IntakeConfig(identity="linked", keep_session=True)).collect()
    assert [r.session_id for r in out] == [0]
