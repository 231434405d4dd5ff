"""A small hand-made response table covering the rules of FIXTURES.md section A."""

from __future__ import annotations

from seatwise.sources.codebook import QUESTIONS

COLUMNS = ["session_id", "time_start", "time_end", "nombre", "edad", "genero", "lgbt", "trans",
           "pais", "disca", "educacion", "areas", "nivel_programacion", "nivel_r", "correo"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)

BASE = dict(time_start="2026-06-01 09:00:00", edad="30", genero="femenino", lgbt="no", trans="no",
            pais="chile", disca="no", educacion="mag_ster", areas="sociolog_a",
            nivel_programacion="no", nivel_r="ninguno")
TEST_NAME = "Prueba Interna"


def _row(sid, t, name, mail, **kw):
    d = dict(BASE, session_id=sid, time_end=t, nombre=name, correo=mail)
    d.update(kw)
    return tuple(d[c] for c in COLUMNS)


def response_rows() -> list[tuple]:
    rows = [
        _row("s01", "2026-06-01 10:00:00", "Ana Null", None),                      # null e-mail
        _row("s02", "2026-06-01 10:00:00", "Eva Empty", ""),                       # empty e-mail
        _row("s03", "2026-06-01 10:00:00", "Carla Caps", " Carla.Caps @Mail.CL "), # spaces, capitals
        _row("s04", "2026-06-01 10:00:00", "Dora Nodot", "dora@mailcl"),           # no dot after @
        _row("s05", "2026-06-01 10:00:00", TEST_NAME, "t@t.cl"),                    # test name, exact
        _row("s06", "2026-06-01 10:00:00", TEST_NAME.lower(), "t2@t.cl"),           # test name, other case
        _row("s07", "2026-06-02 10:00:00", "Rita Repeat", "bad-mail"),             # first of three, bad e-mail
        _row("s08", "2026-06-03 10:00:00", "Rita Repeat", "rita@ok.cl"),
        _row("s09", "2026-06-04 10:00:00", "rita  repeat", "rita2@ok.cl"),
        _row("s11", "2026-06-05 10:00:00", "Tina Tie", "tina1@ok.cl", pais="argentina"),  # equal times
        _row("s10", "2026-06-05 10:00:00", "Tina Tie", "tina2@ok.cl", pais="per"),
        _row("s12", "2026-06-01 10:00:00", "Nora\u00a0No  Break", "nora@ok.cl"),   # no-break space
        _row("s13", "2026-06-14 00:00:00", "Cora Cutoff", "cora@ok.cl"),           # exactly at cut-off
        _row("s14", "2026-06-14 00:00:01", "Olga Over", "olga@ok.cl"),             # one second after
        _row("s15", None, "Nina Notime", "nina@ok.cl"),                            # null time
        _row("s16", "2026-06-02 11:00:00", "Sara Si", "sara@ok.cl", lgbt="s", trans="s",
             disca="s_con_credencial_o_pensi_n_de_invalidez"),
        _row("s17", "2026-06-02 12:00:00", "Nadia Nulls", "nadia@ok.cl", genero=None, lgbt=None,
             pais=None, disca=None),
        _row("s18", "2026-06-02 13:00:00", "Emma Experta", "emma@ok.cl", nivel_r="experto"),
        _row("s19", "2026-06-02 14:00:00", "Edu Noage", "edu@ok.cl", edad="treinta"),
        _row("s20", "2026-06-02 15:00:00", "S", "s@ok.cl", edad="s", genero="s"),          # 's' in text columns
    ]
    # Every code of the codebook at least once, on rows that pass every filter.
    i = 100
    for qid, _qtype, _label, options in QUESTIONS:
        for _opt_label, code in options:
            i += 1
            rows.append(_row(f"s{i}", f"2026-06-03 {i % 24:02d}:{i % 60:02d}:00", f"Persona {i}",
                             f"p{i}@ok.cl", **{qid: code}))
    return rows


def responses(spark):
    return spark.createDataFrame(response_rows(), SCHEMA)
