"""Parameters of the intake jobs, in one place.

Defaults reproduce the behaviour of the selection and exploration scripts the
package was built from; every one can be changed per call.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from seatwise.operators.scoring import Rule

# ---------------------------------------------------------------------------
# FIXED VALUES - defaults that must match the scripts' results.
# ---------------------------------------------------------------------------
CUTOFF = "2026-06-14 00:00:00"          # inclusive closing time, UTC
EMAIL_PATTERN = r"@.*\."                # unanchored: an "@" later followed by a "."
YES_PATTERN = "^s$"                     # stored code of "Sí" ...
YES_VALUE = "sí"                        # ... repaired to the word
SEATS = 160
EXCLUSIONS = [
    ("nivel_programacion", "s_m_s_de_uno"),
    ("areas", "otra_que_no_es_de_ciencias_sociales_ni_humanidades"),
    ("nivel_r", "intermedio"),
    ("nivel_r", "avanzado"),
]
SCORE_BASE = 1.0
SCORE_RULES = [
    Rule("genero", "in", ["no_binario", "queer_ag_nero_otro"], 2),
    Rule("genero", "eq", "femenino", 3),
    Rule("lgbt", "eq", "sí", 2),
    Rule("pais", "eq", "chile", 3),
    Rule("disca", "eq", "s_con_credencial_o_pensi_n_de_invalidez", 2),
    Rule("disca", "eq", "s_sin_credencial_o_pensi_n_de_invalidez", 1),
    Rule("nivel_programacion", "eq", "sí", -2),
    Rule("nivel_r", "in", ["intermedio", "avanzado"], -2),
]
SCORE_FLOOR_AT, SCORE_FLOOR_TO = 0.0, 1.0
GUARANTEED = ("trans", "sí")            # everyone with this answer gets a seat
TIPO_ADMITTED, TIPO_APPLICANTS = "inscritos/as", "postulaciones"
GENERO_RECODE = {"queer_ag_nero_otro": "queer, agénero, otros"}
NIVEL_R_RECODE = {"lo_vi_en_la_universidad_pero_no_entend_nada":
                  "lo vi en la universidad,\npero no entendí nada"}
NIVEL_R_FIRST = ["avanzado", "intermedio", "principiante", "ninguno"]
AREAS_REPAIRS = [("g a", "gía"), ("m a", "mía"), ("f a", "fía"),
                 ("pol tica", "política"), ("ci n", "ción")]
AREAS_WRAP = 30
PAIS_RECODE = {"m_xico": "méxico", "per": "perú", "espa_a": "españa"}
GENDER_CHART_LEVELS = ["no binario", "femenino", "masculino"]
LGBT_CHART_DROP = "prefiero_no_decirlo"
AREAS_TOP, AREAS_OTHER = 10, "otras disciplinas"
PAIS_TOP, PAIS_OTHER = 7, "Otros\npaíses"
# ---------------------------------------------------------------------------


@dataclass
class IntakeConfig:
    name_col: str = "nombre"
    email_col: str = "correo"
    time_col: str = "time_end"
    session_col: str = "session_id"
    time_prefix: str = "time"
    exclude_names: tuple[str, ...] = ()          # test submissions, matched exactly
    cutoff: str | None = CUTOFF
    email_pattern: str = EMAIL_PATTERN
    yes_pattern: str = YES_PATTERN
    yes_value: str = YES_VALUE
    dedup_method: str = "window"
    dedup_extra_keys: tuple[str, ...] = ()       # e.g. ("correo",): two people, one name
    identity: str = "name"                       # "linked": rows that share a name or a valid e-mail are one person
    validate_before_dedup: bool = False          # True: bad answers cannot shadow good ones
    keep_session: bool = False                   # the scripts drop it; we use it as tie-break


@dataclass
class ScoreConfig:
    rules: list[Rule] = field(default_factory=lambda: list(SCORE_RULES))
    base: float = SCORE_BASE
    floor_at: float | None = SCORE_FLOOR_AT
    floor_to: float = SCORE_FLOOR_TO
    name: str = "puntaje"
    after: str | None = "nombre"
    rank_name: str = "id"
    rank_order: tuple[str, ...] = ("-puntaje", "time_end", "nombre")
    rank_method: str = "auto"


@dataclass
class DrawConfig:
    seats: int = SEATS
    seed: int = 1
    id_col: str = "id"
    weight: str | None = "puntaje"
    guaranteed_col: str | None = GUARANTEED[0]
    guaranteed_value: object = GUARANTEED[1]
    list_col: str | None = "correo"
    on_short: str = "error"
    null_weight: str = "error"
    guaranteed_in_draw: bool = True              # False: guaranteed people leave the draw
    max_broadcast_rows: int = 1_000_000
