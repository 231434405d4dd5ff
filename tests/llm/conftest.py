"""Shared rows for the operator tests: every odd case in one small table."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

PROSE = " ".join(f"word{i % 97}x{i}" for i in range(300))
LONG = " ".join(f"w{i}" for i in range(40_000))

ROWS = [
    (1, PROSE, "en", "a", 7),
    (2, PROSE, "en", "b", None),              # an exact copy
    (3, PROSE + " tail", None, "a", 7),       # a near copy
    (4, None, "fr", None, None),              # no text, no source
    (5, "", "fr", "c", 0),
    (6, " \n\t ", "", "", 3),
    (7, "two words", "de", "a", 9),
    (8, "two words", "de", "a", 9),
    (8, "two words", "de", "a", 9),           # a repeated row
    (None, "no id here", "es", "b", 1),
    (None, None, None, None, None),
    (9, LONG, "en", "b", len(LONG)),
    (10, "ÄÖ ß 漢字 \U0001f600 mixed", "de", "b", 4),
    (11, "x" * 100_000, "en", "c", 100_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use for results or inside
CLASHES = ["size", "at", "nth", "key", "row", "copies", "target", "score", "predicted", "secrets", "pii", "kept",
           "n_words", "lines", "shard", "slot", "class_id", "first", "doc", "removed", "doc_key", "stats", "id", "bands", "md5"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    return odd.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}
