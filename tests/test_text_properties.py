"""Property tests: the JVM text expressions against plain-Python references."""

import re
import textwrap

from hypothesis import given, settings
from hypothesis import strategies as st

from seatwise.functions import replace_first, slug, squish, wrap

ALPHABET = st.sampled_from(list("abcxyz_ \u00e1\u00e9\u00f1") + ["\t", "\n", "\u00a0"])
TEXTS = st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=40)
WORDS = st.lists(st.lists(st.text(st.sampled_from(list("abcdef")), min_size=1, max_size=12),
                          min_size=1, max_size=10).map(" ".join), min_size=1, max_size=30)


def run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


@settings(max_examples=15, deadline=None, derandomize=True)
@given(TEXTS)
def test_squish(spark, values):
    want = [re.sub("[ \t\n\u00a0]+", " ", v).strip(" ") for v in values]
    assert run(spark, values, squish("x")) == want


@settings(max_examples=15, deadline=None, derandomize=True)
@given(TEXTS)
def test_replace_first(spark, values):
    assert run(spark, values, replace_first("x", "_", "-")) == [v.replace("_", "-", 1) for v in values]
    assert run(spark, values, replace_first("x", "a b", "Z")) == [re.sub("a b", "Z", v, count=1) for v in values]


@settings(max_examples=15, deadline=None, derandomize=True)
@given(TEXTS)
def test_slug(spark, values):
    want = [re.sub("[^a-z0-9]+", "_", v.lower()).strip("_") for v in values]
    assert run(spark, values, slug("x")) == want


@settings(max_examples=15, deadline=None, derandomize=True)
@given(WORDS, st.integers(min_value=1, max_value=20))
def test_wrap_is_greedy_fill(spark, values, width):
    want = [textwrap.fill(v, width, break_long_words=False, break_on_hyphens=False) for v in values]
    assert run(spark, values, wrap("x", width)) == want
