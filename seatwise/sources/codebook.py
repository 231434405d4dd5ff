"""The response form's codebook as a table, and the required-question list.

Columns: question_id, qtype, label, option_label, option_code (all strings; free-text
questions have one row with null option fields).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# FIXED VALUES - must equal the form definition the responses were stored with.
# Question id, type, and options as (label, stored code), in form order.
# ---------------------------------------------------------------------------
QUESTIONS = [
    ("nombre", "text", "Nombre y apellido", []),
    ("edad", "text", "Edad", []),
    ("genero", "mc", "Género", [
        ("Femenino", "femenino"),
        ("No binario", "no_binario"),
        ("Masculino", "masculino"),
        ("Queer/agénero/otro", "queer_ag_nero_otro"),
        ("Prefiero no decirlo", "prefiero_no_decirlo"),
    ]),
    ("lgbt", "mc", "¿Te identificas con alguna orientación sexual, condición, o identidad de "
                   "género dentro del espectro LGBTIQ+ (lesbianas, gays, bisexuales, trans, "
                   "intersex, queer, asexuales, entre otros)?", [
        ("Sí", "s"),
        ("No", "no"),
        ("Prefiero no decirlo", "prefiero_no_decirlo"),
    ]),
    ("trans", "mc", "¿Eres una persona transgénero? (Transicionaste social y/o médicamente a "
                    "un género distinto al que naciste)", [
        ("Sí", "s"),
        ("No", "no"),
        ("Prefiero no decirlo", "prefiero_no_decirlo"),
    ]),
    ("pais", "select", "¿En qué país vives?", [
        ("Argentina", "argentina"),
        ("Bolivia", "bolivia"),
        ("Brasil", "brasil"),
        ("Chile", "chile"),
        ("Colombia", "colombia"),
        ("Costa Rica", "costa_rica"),
        ("Cuba", "cuba"),
        ("Ecuador", "ecuador"),
        ("El Salvador", "el_salvador"),
        ("Guatemala", "guatemala"),
        ("Honduras", "honduras"),
        ("México", "m_xico"),
        ("Nicaragua", "nicaragua"),
        ("Panamá", "panam"),
        ("Paraguay", "paraguay"),
        ("Perú", "per"),
        ("Puerto Rico", "puerto_rico"),
        ("República Dominicana", "rep_blica_dominicana"),
        ("Uruguay", "uruguay"),
        ("Venezuela", "venezuela"),
        ("España", "espa_a"),
        ("Otro", "otro"),
    ]),
    ("disca", "mc", "¿Te encuentras en situación de discapacidad?", [
        ("Sí, con credencial o pensión de invalidez", "s_con_credencial_o_pensi_n_de_invalidez"),
        ("Sí, sin credencial o pensión de invalidez", "s_sin_credencial_o_pensi_n_de_invalidez"),
        ("No", "no"),
        ("Prefiero no decirlo", "prefiero_no_decirlo"),
    ]),
    ("educacion", "mc_buttons", "¿Cuál es tu nivel educacional?", [
        ("Estudiante de educación universitaria", "estudiante_de_educaci_n_universitaria"),
        ("Educación universitaria completa", "educaci_n_universitaria_completa"),
        ("Estudiante de magíster", "estudiante_de_mag_ster"),
        ("Magíster", "mag_ster"),
        ("Estudiante de doctorado", "estudiante_de_doctorado"),
        ("Doctorado", "doctorado"),
    ]),
    ("areas", "mc_buttons", "¿A qué carrera o disciplina perteneces? (Elige la principal)", [
        ("Sociología", "sociolog_a"),
        ("Antropología", "antropolog_a"),
        ("Ciencia Política", "ciencia_pol_tica"),
        ("Geografía", "geograf_a"),
        ("Historia", "historia"),
        ("Derecho", "derecho"),
        ("Economía", "econom_a"),
        ("Literatura", "literatura"),
        ("Filosofía", "filosof_a"),
        ("Psicología", "psicolog_a"),
        ("Trabajo Social", "trabajo_social"),
        ("Educación", "educaci_n"),
        ("Comunicación", "comunicaci_n"),
        ("Artes", "artes"),
        ("Otra de ciencias sociales", "otra_de_ciencias_sociales"),
        ("Otra de humanidades", "otra_de_humanidades"),
        ("Otra que no es de ciencias sociales ni humanidades",
         "otra_que_no_es_de_ciencias_sociales_ni_humanidades"),
    ]),
    ("nivel_programacion", "mc_buttons", "¿Manejas algún lenguaje de programación?", [
        ("Sí, más de uno", "s_m_s_de_uno"),
        ("Sí, uno", "s_uno"),
        ("No", "no"),
    ]),
    ("nivel_r", "mc_buttons", "¿Cuál es tu nivel de conocimientos de R?", [
        ("Ninguno", "ninguno"),
        ("Principiante", "principiante"),
        ("Intermedio", "intermedio"),
        ("Avanzado", "avanzado"),
        ("Experto", "experto"),
        ("Lo vi en la universidad pero no entendí nada", "lo_vi_en_la_universidad_pero_no_entend_nada"),
    ]),
    ("correo", "text", "Correo electrónico", []),
]

# Every question is required, in this order.
REQUIRED = ["nombre", "edad", "genero", "lgbt", "trans", "pais", "disca", "educacion",
            "areas", "nivel_programacion", "nivel_r", "correo"]
# ---------------------------------------------------------------------------

CODEBOOK_SCHEMA = ("question_id string, qtype string, label string, "
                   "option_label string, option_code string")


NAMES = ["question_id", "qtype", "label", "option_label", "option_code"]


def codebook_rows(questions=None) -> list[tuple]:
    rows = []
    for qid, qtype, label, options in (questions or QUESTIONS):
        if not options:
            rows.append((qid, qtype, label, None, None))
        for opt_label, code in options:
            rows.append((qid, qtype, label, opt_label, code))
    return rows


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """The codebook of a form from its definition file: blocks of two-space steps, one per
    question id, with ``type``, ``label`` and, below ``choice`` or ``option``, lines
    ``"label": code`` (quotes are optional).  Five columns, as ``codebook_df`` has them.

    The file is a form's definition, read as text by Spark and parsed as a whole in one
    task."""
    def parse(frames):
        for f in frames:
            for text in f["value"]:
                yield pd.DataFrame(codebook_rows(parse_form(text)), columns=NAMES, dtype=object)
    return spark.read.text(path, wholetext=True).mapInPandas(parse, CODEBOOK_SCHEMA)


_ENTRY = re.compile(r"""^(?P<indent>\s*)(?:-\s+)?(?P<key>"(?:[^"\\]|\\.)*"|'[^']*'|[^:#]+?)\s*:\s*(?P<value>.*?)\s*$""")


def _scalar(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1].replace('\\"', '"')
    return text


def parse_form(text: str) -> list[tuple]:
    """(id, type, label, [(option label, code)]) of each question of a definition."""
    out, current, options_at, label_at = [], None, None, None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if label_at is not None and len(line) - len(line.lstrip()) > label_at:
            current[2] += " " + line.strip()          # a long label goes on
            continue
        label_at = None
        m = _ENTRY.match(line)
        if not m:
            continue
        indent, key, value = len(m["indent"]), _scalar(m["key"]), _scalar(m["value"])
        if options_at is not None and indent > options_at:
            current[3].append((key, value))
            continue
        options_at = None
        if value == "" and key in ("choice", "choices", "option", "options"):
            options_at = indent
        elif key == "type" and current:
            current[1] = value
        elif key == "label" and current:
            current[2], label_at = value, indent
        elif value == "":
            current = [key, None, None, []]
            out.append(current)
    # blocks that are no question (a wrapping key) have neither type nor options
    return [tuple(q) for q in out if q[1] or q[3]]


def codebook_df(spark: SparkSession, questions=None) -> DataFrame:
    """The codebook as a DataFrame (a few dozen rows; a broadcast dimension)."""
    return spark.createDataFrame(codebook_rows(questions), CODEBOOK_SCHEMA)


def response_schema(time_columns=("time_start", "time_end"), session_col: str = "session_id",
                    questions=None) -> str:
    """DDL schema of the response table: session id, ``time*`` columns and one string
    column per question, in form order.  Pass it to the readers so a large response
    folder is not scanned for inference."""
    cols = [session_col, *time_columns] + [q for q, _t, _l, _o in (questions or QUESTIONS)]
    return ", ".join(f"`{c}` string" for c in cols)
