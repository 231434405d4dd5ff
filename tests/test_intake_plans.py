"""The composite jobs on the hand-made response table."""

import sys

import pytest
from pyspark.sql import functions as F

from seatwise.plans.config import DrawConfig, IntakeConfig
from seatwise.plans.explore import chart_tables, harmonise
from seatwise.plans.intake import anonymised_snapshot, apply_exclusions, clean_intake
from seatwise.plans.report import profile_report, recipient_list
from seatwise.plans.selection import score_applicants, seat_draw
from seatwise.sources.codebook import REQUIRED
from tests.conftest import SF01
from tests.fixtures import TEST_NAME, responses

CFG = IntakeConfig(exclude_names=(TEST_NAME,))


@pytest.fixture(scope="module")
def clean(spark):
    return clean_intake(responses(spark), CFG).cache()


def by_name(df):
    return {r["nombre"]: r for r in df.collect()}


@pytest.mark.parametrize("method", ["aggregate", "window"])
def test_clean_intake_rules(spark, method):
    from dataclasses import replace
    rows = by_name(clean_intake(responses(spark), replace(CFG, dedup_method=method)))
    assert "ana null" not in rows and "eva empty" not in rows          # null / empty e-mail
    assert rows["carla caps"]["correo"] == "carla.caps@mail.cl"         # lower + de-spaced
    assert "dora nodot" not in rows                                      # no dot after @
    assert TEST_NAME.lower() not in [n for n in rows if n == TEST_NAME]  # exact test name gone
    assert TEST_NAME.lower() in rows                                     # other case stays
    assert "rita repeat" not in rows        # first answer (bad e-mail) wins, then fails
    assert rows["tina tie"]["pais"] == "per"                             # tie -> lower session id
    assert "nora no break" in rows                                       # no-break space squished
    assert "cora cutoff" in rows and "olga over" not in rows and "nina notime" not in rows
    assert rows["sara si"]["lgbt"] == "sí" and rows["sara si"]["trans"] == "sí"
    assert rows["sí"]["edad"] == "sí" and rows["sí"]["genero"] == "sí"  # every string column
    assert rows["nadia nulls"]["genero"] is None


def test_clean_intake_columns(clean):
    assert "session_id" not in clean.columns and "time_start" not in clean.columns
    assert clean.columns[-1] == "time_end"
    assert dict(clean.dtypes)["time_end"] == "timestamp"
    assert clean.groupBy("nombre").count().filter("count > 1").count() == 0


def test_snapshot_drops_personal_columns(spark, clean, scratch):
    path = anonymised_snapshot(clean, f"{scratch}/snap")
    back = spark.read.parquet(path)
    assert "nombre" not in back.columns and "correo" not in back.columns
    assert back.count() == clean.count()


def test_exclusions(clean):
    out = apply_exclusions(clean)
    assert out.filter(F.col("nivel_r").isin("intermedio", "avanzado")).count() == 0
    assert out.filter(F.col("nivel_programacion") == "s_m_s_de_uno").count() == 0
    assert out.filter(F.col("nombre") == "emma experta").count() == 1    # experto not excluded
    assert out.filter(F.col("nombre") == "nadia nulls").count() == 1     # nulls elsewhere stay


def test_scores(clean):
    s = by_name(score_applicants(apply_exclusions(clean)))
    assert s["sara si"]["puntaje"] == 11.0
    assert s["nadia nulls"]["puntaje"] is None
    assert s["carla caps"]["puntaje"] == 7.0
    ids = sorted(r["id"] for r in s.values())
    assert ids == list(range(1, len(ids) + 1))
    assert s["sara si"]["id"] == 1 and s["nadia nulls"]["id"] == len(ids)   # null score last
    cols = score_applicants(apply_exclusions(clean)).columns
    assert cols[cols.index("nombre") + 1] == "puntaje"


def test_seat_draw(spark, clean):
    scored = score_applicants(apply_exclusions(clean)).filter(F.col("puntaje").isNotNull())
    special = spark.createDataFrame([("carla.caps@mail.cl",), ("NOBODY@X.CL",)], "value string")
    cfg = DrawConfig(seats=5, seed=7)
    adm = seat_draw(scored, cfg, special_list=special)
    names = {r["nombre"] for r in adm.collect()}
    trans = {r["nombre"] for r in scored.filter(F.col("trans") == "sí").collect()}
    assert trans <= names and "carla caps" in names
    assert 5 <= len(names) <= 5 + len(trans) + 1
    assert adm.count() == len(names)
    again = {r["nombre"] for r in seat_draw(scored.repartition(3), cfg, special_list=special).collect()}
    assert again == names


def test_null_score_draw_is_an_error(clean):
    scored = score_applicants(apply_exclusions(clean))
    with pytest.raises(Exception):
        seat_draw(scored, DrawConfig(seats=3, guaranteed_col=None, list_col=None)).collect()


def test_report_and_recipients(spark, clean):
    scored = score_applicants(apply_exclusions(clean))
    rep = profile_report(scored)
    assert rep["mean_age"].first()["mean"] is None                       # 'treinta' -> NA
    assert {r["trans"] for r in rep["country_trans"].collect()} <= {"sí"}
    assert rep["head"].count() == 6 and [r["id"] for r in rep["tail"].collect()][-1] == scored.count()
    rec = recipient_list(scored, batch_size=1000).collect()
    assert len(rec) == 1 and rec[0]["recipients"].count(", ") == scored.count() - 1


@pytest.mark.parametrize("two_phase", [False, True])
def test_recipients_of_a_table_that_grows(spark, monkeypatch, two_phase):
    """The catalogue's recipient queries read nation; here, batches of customer."""
    if two_phase:
        monkeypatch.setattr(sys.modules["seatwise.operators.ordinal"], "estimated_bytes", lambda df: 2 ** 63 - 1)
    people = spark.read.parquet(f"{SF01}/customer.parquet").select("c_custkey", "c_name").repartition(5)
    names = [r.c_name or "NA" for r in sorted(people.collect(), key=lambda r: r.c_custkey)]
    for size in (1000, 7):
        want = [", ".join(names[i:i + size]) for i in range(0, len(names), size)]
        got = recipient_list(people, size, "c_name", "c_custkey").collect()
        assert len(want) > 1 and [r.recipients for r in sorted(got, key=lambda r: r.batch)] == want


def test_harmonise_and_charts(spark, clean):
    scored = score_applicants(apply_exclusions(clean)).filter(F.col("puntaje").isNotNull())
    adm = seat_draw(scored, DrawConfig(seats=20, seed=3)).drop("nombre", "correo", "puntaje")
    datos = harmonise(adm, clean.drop("nombre", "correo"))
    assert {r["tipo"] for r in datos.select("tipo").distinct().collect()} == {"inscritos/as", "postulaciones"}
    labels = {r["pais"] for r in datos.select("pais").distinct().collect()}
    assert "Perú" in labels and "Costa_rica" in labels and "Panam" in labels
    gen = {r["genero"] for r in datos.select("genero").distinct().collect()}
    assert "queer, agénero, otros" in gen and "prefiero no_decirlo" in gen and "no binario" in gen
    areas = {r["areas"] for r in datos.select("areas").distinct().collect()}
    assert "otra que no es de ciencias\nsociales ni humanidades" in areas and "sociología" in areas
    lv = {r["nivel_r"]: r["nivel_r_ord"] for r in datos.select("nivel_r", "nivel_r_ord").distinct().collect()}
    assert [k for k, _ in sorted(lv.items(), key=lambda kv: kv[1])][:4] == \
        ["avanzado", "intermedio", "principiante", "ninguno"]
    charts = chart_tables(datos)
    for name in ["gender", "lgbt", "level", "areas"]:
        for row in charts[name].groupBy("tipo").agg(F.sum("p").alias("s")).collect():
            assert abs(row["s"] - 1.0) < 1e-9, name
    assert abs(sum(r["p"] for r in charts["countries"].collect()) - 1.0) < 1e-9
    assert charts["age"].count() == 512


def test_conformance_on_responses(spark):
    from seatwise.operators.codebook import conformance, decode
    from seatwise.sources.codebook import codebook_df
    df = responses(spark)
    rep = {r["question_id"]: r for r in conformance(df, codebook_df(spark), REQUIRED).collect()}
    assert rep["correo"]["n_missing"] == 1
    assert rep["genero"]["n_missing"] == 1 and rep["genero"]["n_out_of_domain"] == 1   # 's'
    assert rep["nivel_r"]["n_out_of_domain"] == 0
    dec = decode(df, codebook_df(spark), ["pais"]).filter(F.col("pais") == "per").first()
    assert dec["pais_label"] == "Perú"


def test_switches(spark):
    from dataclasses import replace
    raw = responses(spark)
    v = by_name(clean_intake(raw, replace(CFG, validate_before_dedup=True)))
    assert v["rita repeat"]["correo"] == "rita@ok.cl"          # the good later answer wins
    k = clean_intake(raw, replace(CFG, dedup_extra_keys=("correo",)))
    assert k.filter(F.col("nombre") == "tina tie").count() == 2   # two e-mails, two people
    scored = score_applicants(apply_exclusions(clean_intake(raw, CFG))).filter(F.col("puntaje").isNotNull())
    cfg = DrawConfig(seats=10, seed=4, guaranteed_in_draw=False)
    adm = seat_draw(scored, cfg)
    n_trans = scored.filter(F.col("trans") == "sí").count()
    assert adm.count() == 10 + n_trans


def test_codebook_labels(spark, clean):
    from seatwise.plans.explore import harmonise
    from seatwise.sources.codebook import codebook_df
    scored = score_applicants(apply_exclusions(clean)).filter(F.col("puntaje").isNotNull())
    adm = seat_draw(scored, DrawConfig(seats=20, seed=3)).drop("nombre", "correo", "puntaje")
    datos = harmonise(adm, clean.drop("nombre", "correo"), codebook=codebook_df(spark))
    pais = {r["pais"] for r in datos.select("pais").distinct().collect()}
    assert {"Panamá", "República Dominicana", "Costa Rica", "Perú"} <= pais
    lv = {r["nivel_r"]: r["nivel_r_ord"] for r in datos.select("nivel_r", "nivel_r_ord").distinct().collect()}
    assert [k for k, _ in sorted(lv.items(), key=lambda kv: kv[1])][:4] == \
        ["Avanzado", "Intermedio", "Principiante", "Ninguno"]


def test_conformance_without_known_questions(spark):
    from seatwise.operators.codebook import conformance
    from seatwise.sources.codebook import codebook_df
    df = spark.createDataFrame([("a",)], "other string")
    assert conformance(df, codebook_df(spark), ["missing_q"]).count() == 0


def test_auto_percent_digits(spark):
    from seatwise.plans.explore import auto_percent_digits
    mk = lambda ps: spark.createDataFrame([(p,) for p in ps], "p double")
    assert auto_percent_digits(mk([0.123456, 0.45678])) == 0       # gap 33 points -> whole %
    assert auto_percent_digits(mk([0.1234, 0.1256])) == 2          # gap 0.22 points -> 0.01 %
    assert auto_percent_digits(mk([0.5])) == 0


def test_other_level_last_on_equal_share(spark):
    from seatwise.plans.explore import _reorder_other_last
    c = spark.createDataFrame([("zeta", 0.25), ("otras", 0.25), ("alfa", 0.5)], "areas string, p double")
    o = {r["areas"]: r["areas_ord"] for r in _reorder_other_last(c, "areas", "otras").collect()}
    assert o == {"zeta": 1, "otras": 2, "alfa": 3}


def test_stack_populations_type_clash(spark):
    from seatwise.plans.explore import stack_populations
    adm = spark.createDataFrame([(1, "a", 3)], "id int, pais string, n int")
    ok = stack_populations(adm, spark.createDataFrame([("b", 2.5)], "pais string, n double"), numeric=())
    assert dict(ok.dtypes)["n"] == "double" and ok.count() == 2
    with pytest.raises(TypeError):
        stack_populations(adm, spark.createDataFrame([(7, 1)], "pais int, n int"), numeric=())
