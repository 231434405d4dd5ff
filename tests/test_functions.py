from pyspark.sql import functions as F

from seatwise.functions import (
    case_default, filter_out, if_else, is_in, percent_label, remove_all, replace_each_first,
    replace_first, slug, squish, title_case, to_number, wrap,
)
from seatwise.sources.codebook import QUESTIONS


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr.alias("y")).first()["y"]


def test_squish_handles_unicode_spaces(spark):
    assert one(spark, squish("x"), "  a  b \t c\n") == "a b c"
    assert one(spark, squish("x"), None) is None


def test_remove_all_spaces(spark):
    assert one(spark, remove_all("x", " "), " a b  c ") == "abc"


def test_replace_first_only(spark):
    assert one(spark, replace_first("x", "_", " "), "prefiero_no_decirlo") == "prefiero no_decirlo"
    assert one(spark, replace_first("x", "_", " "), "nada") == "nada"
    assert one(spark, replace_first("x", "a", "$1\\"), "banana") == "b$1\\nana"
    assert one(spark, replace_first("x", "b", "B"), "a\nb\nb") == "a\nB\nb"


def test_repairs_in_order(spark):
    pairs = [("g a", "gía"), ("m a", "mía"), ("f a", "fía"), ("pol tica", "política"), ("ci n", "ción")]
    for raw, want in [("sociolog a", "sociología"), ("econom a", "economía"), ("geograf a", "geografía"),
                      ("ciencia pol tica", "ciencia política"), ("comunicaci n", "comunicación")]:
        assert one(spark, replace_each_first("x", pairs), raw) == want


def test_wrap_greedy(spark):
    s = "otra que no es de ciencias sociales ni humanidades"
    assert one(spark, wrap("x", 30), s) == "otra que no es de ciencias\nsociales ni humanidades"
    assert one(spark, wrap("x", 30), "historia") == "historia"
    assert one(spark, wrap("x", 3), "abcdefg hi") == "abcdefg\nhi"


def test_slug_reproduces_every_code(spark):
    pairs = [(lab, code) for _q, _t, _l, opts in QUESTIONS for lab, code in opts]
    assert len(pairs) == 69
    df = spark.createDataFrame(pairs, "label string, code string")
    bad = df.filter(slug("label") != F.col("code")).collect()
    assert bad == []


def test_if_else_three_valued(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    got = [r["y"] for r in df.select(if_else(F.col("x") == "a", 1, 0).alias("y")).collect()]
    assert got == [1, None, 0]
    got = [r["y"] for r in df.select(case_default(F.col("x") == "a", 1, 0).alias("y")).collect()]
    assert got == [1, 0, 0]


def test_is_in_never_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("c",)], "x string")
    assert [r["y"] for r in df.select(is_in("x", ["a", "b"]).alias("y")).collect()] == [True, False, False]


def test_filter_out_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    assert sorted(filter_out(df, F.col("x") == "a").collect(), key=str) == sorted(
        [df.collect()[1], df.collect()[2]], key=str)
    assert df.filter(F.col("x") != "a").count() == 1   # plain filter drops the null


def test_to_number(spark):
    assert one(spark, to_number("x"), " 25 ") == 25.0
    assert one(spark, to_number("x"), "treinta") is None
    assert one(spark, to_number("x"), "") is None


def test_percent_and_title(spark):
    assert one(spark, percent_label("x", 1), 0.1234, "double") == "12.3%"
    assert one(spark, percent_label("x", 0), 0.5, "double") == "50%"
    assert one(spark, percent_label("x", 1), None, "double") is None
    assert one(spark, title_case("x"), "costa_rica") == "Costa_rica"
    assert one(spark, title_case("x"), "méxico lindo") == "México Lindo"


def test_recode_case_and_map_forms_agree(spark):
    from seatwise.functions.recode import CASE_MAX, recode
    big = {f"k{i}": f"v{i}" for i in range(CASE_MAX + 10)}
    small = {"k1": "v1", "k3": "v3"}
    df = spark.createDataFrame([("k1",), ("k3",), ("zz",), (None,), ("k40",)], "x string")
    assert [r["y"] for r in df.select(recode("x", small).alias("y")).collect()] == ["v1", "v3", "zz", None, "k40"]
    assert [r["y"] for r in df.select(recode("x", big).alias("y")).collect()] == ["v1", "v3", "zz", None, "v40"]


def test_as_timestamp_kinds(spark):
    from seatwise.functions.convert import as_timestamp
    df = spark.createDataFrame([(1781395200, "2026-06-14 00:00:00", "2026-06-14T00:00:00Z", "nope")],
                               "n long, s string, iso string, bad string")
    r = df.select(*[as_timestamp(df, c).cast("string").alias(c) for c in df.columns]).first()
    assert r["n"] == r["s"] == r["iso"] == "2026-06-14 00:00:00" and r["bad"] is None


def test_percent_label_ties_to_even(spark):
    assert one(spark, percent_label("x", 1), 0.1225, "double") == "12.2%"    # exactly 12.25: tie to even
    assert one(spark, percent_label("x", 0), 0.125, "double") == "12%"       # exact tie 12.5 -> 12
    assert one(spark, percent_label("x", 0), 0.135, "double") == "14%"
