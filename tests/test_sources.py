
from seatwise.sources import column_profile, glimpse, read_csv2, read_line_list, write_csv2
from seatwise.sources.writers import write_text_lines
from tests.conftest import SF01


def test_csv2_roundtrip_comma_decimals(spark, scratch):
    df = spark.createDataFrame([(1, "a", 1.5, None), (2, None, -1234.25, 3.0)],
                               "id int, s string, x double, y double")
    path = write_csv2(df, f"{scratch}/c")
    text = "".join(open(f).read() for f in __import__("glob").glob(f"{path}/*.csv"))
    assert "1,5" in text and ";" in text and "NA" in text
    back = read_csv2(spark, path)
    got = {r["id"]: r for r in back.collect()}
    assert got[1]["x"] == 1.5 and got[2]["x"] == -1234.25 and got[1]["y"] is None
    assert got[2]["s"] is None


def test_csv2_thousands_mark(spark, scratch):
    p = f"{scratch}/t.csv"
    open(p, "w").write("id;monto\n1;1.234,5\n2;NA\n3;7\n")
    got = {r["id"]: r["monto"] for r in read_csv2(spark, p).collect()}
    assert got == {1: 1234.5, 2: None, 3: 7.0}


def test_line_list(spark, scratch):
    p = f"{scratch}/l.txt"
    open(p, "w").write("a@b.cl\nC@D.CL\n")
    assert [r["value"] for r in read_line_list(spark, p).collect()] == ["a@b.cl", "C@D.CL"]


def test_text_lines_writer(spark, scratch):
    df = spark.createDataFrame([("x, y",)], "recipients string")
    path = write_text_lines(df, "recipients", f"{scratch}/r")
    assert [r["value"] for r in spark.read.text(path).collect()] == ["x, y"]


def test_glimpse_and_profile(spark):
    c = spark.read.parquet(f"{SF01}/customer.parquet")
    g = glimpse(c, 3).collect()
    assert [r["column"] for r in g] == c.columns and g[0]["sample"].count(",") == 2
    prof = {r["column"]: r for r in column_profile(c).collect()}
    assert prof["c_custkey"]["n_distinct"] == c.count()
    assert prof["c_mktsegment"]["n_distinct"] == 5
    approx = {r["column"]: r for r in column_profile(c, approx=True).collect()}
    assert abs(approx["c_custkey"]["n_distinct"] - c.count()) / c.count() < 0.05


def test_response_schema_reads_the_fixture(spark, scratch):
    from seatwise.sources import read_parquet, response_schema
    from tests.fixtures import responses
    path = f"{scratch}/resp"
    responses(spark).write.parquet(path)
    df = read_parquet(spark, path, schema=response_schema())
    assert df.columns[:3] == ["session_id", "time_start", "time_end"] and "correo" in df.columns
    assert df.count() == responses(spark).count()


def test_csv2_roundtrip_large_and_small_doubles(spark, scratch):
    df = spark.createDataFrame([(1, 12345678.9), (2, 1.5e-7), (3, -2.5e10)], "id int, x double")
    back = {r["id"]: r["x"] for r in read_csv2(spark, write_csv2(df, f"{scratch}/big")).collect()}
    assert back == {1: 12345678.9, 2: 1.5e-7, 3: -2.5e10}


def test_csv2_quotes_separators_and_line_breaks(spark, scratch):
    df = spark.createDataFrame([(1, 'a;b "c"\nd', 2.5)], "id int, s string, x double")
    path = write_csv2(df, f"{scratch}/q")
    back = read_csv2(spark, path, multiline=True).collect()
    assert back[0]["s"] == 'a;b "c"\nd' and back[0]["x"] == 2.5


def test_csv2_one_typing_rule(spark, scratch):
    p = f"{scratch}/types.csv"
    open(p, "w").write("a;b;c;d;e;f\n1.234;1.234,5;2026-01-02;TRUE;x.5;NA\n2.500;7;2026-01-03;FALSE;1.5;NA\n")
    df = read_csv2(spark, p)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "date", "boolean", "string", "string"]
    assert [(r["a"], r["b"], r["e"]) for r in df.collect()] == [(1234, 1234.5, "x.5"), (2500, 7.0, "1.5")]


def test_codebook_from_a_file(spark, scratch):
    from seatwise.sources import read_codebook
    p = f"{scratch}/form.yml"
    open(p, "w").write("# a form\nname:\n  type: text\n  label: Your name\npick:\n  type: mc\n  label: A long question that\n"
                       "    goes on: here\n  options:\n    Yes please: s\n    'No': 'no'\n")
    rows = {tuple(r) for r in read_codebook(spark, p).collect()}
    assert rows == {("name", "text", "Your name", None, None),
                    ("pick", "mc", "A long question that goes on: here", "Yes please", "s"),
                    ("pick", "mc", "A long question that goes on: here", "No", "no")}
