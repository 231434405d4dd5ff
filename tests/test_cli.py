"""Both command-line jobs end to end on the response fixture."""

import glob

from seatwise.cli import main
from tests.fixtures import TEST_NAME, responses


def test_select_then_explore(spark, scratch):
    src = f"{scratch}/responses"
    responses(spark).write.parquet(src)
    special = f"{scratch}/special.txt"
    open(special, "w").write("carla.caps@mail.cl\n")
    out = main(["select", "--responses", src, "--snapshot", f"{scratch}/snap", "--admitted", f"{scratch}/adm",
                "--admitted-csv", f"{scratch}/adm_csv", "--special", special, "--recipients", f"{scratch}/rec",
                "--report", f"{scratch}/report", "--seats", "20", "--seed", "5", "--exclude-name", TEST_NAME, "--null-scores", "skip"],
               spark=spark)
    adm = spark.read.parquet(out["admitted"])
    assert adm.count() >= 20 and adm.filter("correo = 'carla.caps@mail.cl'").count() == 1
    assert "nombre" not in spark.read.parquet(out["snapshot"]).columns
    lines = [r["value"] for r in spark.read.text(out["recipients"]).collect()]
    assert len(lines) == 1 and lines[0].count("@") == adm.count()
    assert glob.glob(f"{scratch}/report/admitted/by_gender/*.parquet")
    charts = main(["explore", "--admitted-csv", out["admitted_csv"], "--snapshot", out["snapshot"],
                   "--out", f"{scratch}/charts"], spark=spark)
    assert set(charts) == {"gender", "lgbt", "level", "areas", "age", "countries"}
    assert spark.read.parquet(charts["age"]).count() == 512
    g = spark.read.parquet(charts["gender"]).groupBy("tipo").sum("p").collect()
    assert all(abs(r["sum(p)"] - 1) < 1e-9 for r in g)


def test_jdbc_arguments_are_checked():
    import pytest
    from seatwise.cli import main
    with pytest.raises(SystemExit):
        main(["select", "--jdbc-url", "jdbc:x://h/db", "--snapshot", "s", "--admitted", "a"])
    with pytest.raises(SystemExit):
        main(["select", "--responses", "r", "--jdbc-url", "jdbc:x://h/db", "--snapshot", "s", "--admitted", "a"])


def test_explore_from_parquet_with_csv(spark, scratch):
    src = f"{scratch}/responses"
    responses(spark).write.parquet(src)
    out = main(["select", "--responses", src, "--snapshot", f"{scratch}/snap", "--admitted", f"{scratch}/adm",
                "--seats", "10", "--exclude-name", TEST_NAME, "--null-scores", "skip"], spark=spark)
    charts = main(["explore", "--admitted", out["admitted"], "--snapshot", out["snapshot"],
                   "--out", f"{scratch}/charts", "--csv", "--codebook-labels"], spark=spark)
    assert "countries_csv" in charts and glob.glob(f"{charts['countries_csv']}/*.csv")
    labels = {r["pais"] for r in spark.read.parquet(charts["countries"]).collect()}
    assert "Chile" in labels
