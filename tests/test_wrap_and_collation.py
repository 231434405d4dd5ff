"""Balanced wrapping against every way to break a text, and level orders of a language."""

import random

import pytest
from pyspark.sql import functions as F

from seatwise.functions.text import wrap, wrap_balanced
from seatwise.operators.categories import relevel_ordinal, reorder_by
from seatwise.operators.counts import count_by
from seatwise.plans.explore import display_labels
from seatwise.sources.codebook import codebook_df


def every_layout(words):
    if not words:
        yield []
    for k in range(1, len(words) + 1):
        for rest in every_layout(words[k:]):
            yield [words[:k], *rest]


def best_layout(text, width):
    words = text.split() or [""]
    found = []
    for lines in every_layout(words):
        size = [len(" ".join(x)) for x in lines]
        if all(n <= width or len(x) == 1 for n, x in zip(size, lines)):
            cost = sum(max(0, width - n) ** 2 for n in size[:-1])
            found.append((cost, [-len(x) for x in reversed(lines)], "\n".join(" ".join(x) for x in lines)))
    return min(found)[2]


@pytest.mark.parametrize("width", [1, 5, 12, 30])
def test_balanced_wrap_is_the_best_of_all(spark, width):
    rng = random.Random(width)
    texts = [" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(0, 10))) for _ in range(60)]
    texts += ["", "  two   words ", "ñandú é í ó ú " * 2, "x" * 50 + " a b c"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.v for r in df.select("t", wrap_balanced("t", width).alias("v")).collect()}
    assert got.pop(None) is None
    assert got == {t: best_layout(t, width) for t in texts}


def test_balanced_wrap_of_a_long_text(spark):
    """Only one line's worth of layouts is kept: a text of 3,000 words is no trouble."""
    text = " ".join(f"w{i}" for i in range(3000))
    lines = spark.createDataFrame([(text,)], "t string").select(wrap_balanced("t", 40)).first()[0].split("\n")
    assert " ".join(lines) == text and max(map(len, lines)) <= 40
    with pytest.raises(ValueError):
        wrap_balanced("t", 0)


def test_both_wraps_agree_on_the_codebook(spark):
    labels = codebook_df(spark).filter("option_label is not null").select(F.col("option_label").alias("t"))
    assert labels.filter(wrap("t", 30) != wrap_balanced("t", 30)).count() == 0
    codes = spark.createDataFrame([("trabajo_social_y_pol_tica_p_blica_de_la_regi_n",)], "areas string")
    assert display_labels(codes, balanced=True).first()[0].count("\n") == 1


WORDS = ["zinc", "ñandú", "nube", "nácar", "oso", "Ébano", "éter", "ágata", "azul", "Ñu", "eco"]
SPANISH = ["ágata", "azul", "Ébano", "eco", "éter", "nácar", "nube", "ñandú", "Ñu", "oso", "zinc"]


def test_spanish_order(spark):
    df = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS)] + [(None, 99), ("oso", 5)], "w string, x int")
    order = [r.w for r in count_by(df, "w", collation="es").collect()]
    assert order == [*SPANISH, None]
    by_n = [r.w for r in count_by(df, "w", sort=True, collation="es").collect()]
    assert by_n == ["oso", *[w for w in SPANISH if w != "oso"], None]
    raw = {r.w: r.w_ord for r in relevel_ordinal(df, "w", ["zinc"], collation="es").collect()}
    per = {r.w: r.w_ord for r in relevel_ordinal(count_by(df, "w", ordered=False), "w", ["zinc"], per_level=True, collation="es").collect()}
    want = {w: i + 1 for i, w in enumerate(["zinc", *[w for w in SPANISH if w != "zinc"]])} | {None: None}
    assert raw == want == per
    same = df.withColumn("m", F.lit(1.0))
    assert {r.w: r.w_ord for r in reorder_by(same, "w", "m", collation="es").collect()} == {w: i + 1 for i, w in enumerate(SPANISH)} | {None: None}


def test_bytes_stay_the_default(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    assert [r.w for r in count_by(df, "w").collect()] == sorted(WORDS, key=str.encode)


def test_an_order_that_ignores_case_keeps_levels_apart(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "w string")
    out = relevel_ordinal(df, "w", [], collation="es_CI").collect()
    assert [r.w for r in sorted(out, key=lambda r: r.w_ord)] == ["A", "a", "B", "b"]
