"""Applicants vs admitted: harmonise both tables, then the six chart tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.functions.convert import to_number
from seatwise.functions.nulls import filter_out, keep_in
from seatwise.functions.recode import recode
from seatwise.functions.text import percent_label, replace_all, replace_each_first, replace_first, title_case, wrap, wrap_balanced
from seatwise.operators.categories import relevel_ordinal, reorder_by
from seatwise.operators.columns import select_any_of
from seatwise.operators.counts import count_by, count_tables
from seatwise.operators.density import density
from seatwise.operators.lump import lump_counts
from seatwise.operators.shares import share_of_total, share_within
from seatwise.plans import config as C
from seatwise.session import stored


def stack_populations(admitted: DataFrame, applicants: DataFrame, tipo: str = "tipo",
                      id_col: str = "id", numeric: tuple[str, ...] = ("edad",)) -> DataFrame:
    """Admitted rows (without ``id_col``) over applicant rows restricted to the
    admitted table's columns, each labelled in ``tipo``; columns in ``numeric``
    become numbers on both sides so the union has one type."""
    adm = admitted.drop(id_col)
    app = applicants
    for c in numeric:
        if c in adm.columns:
            adm = adm.withColumn(c, to_number(c))
        if c in app.columns:
            app = app.withColumn(c, to_number(c))
    app = select_any_of(app, admitted.columns).withColumn(tipo, F.lit(C.TIPO_APPLICANTS))
    adm = adm.withColumn(tipo, F.lit(C.TIPO_ADMITTED))
    # Like appending data frames in R: numbers widen, any other type clash is an error
    # (Spark's union would otherwise coerce, e.g. a number and a text to text).
    at = dict(adm.dtypes)
    for f in app.schema.fields:
        if f.name in at and f.dataType != adm.schema[f.name].dataType:
            other = adm.schema[f.name].dataType
            numeric = isinstance(f.dataType, T.NumericType) and isinstance(other, T.NumericType)
            untyped = isinstance(f.dataType, T.NullType) or isinstance(other, T.NullType)
            if not (numeric or untyped):
                raise TypeError(f"cannot stack column {f.name!r}: {at[f.name]} vs {f.dataType.simpleString()}")
    return adm.unionByName(app, allowMissingColumns=True)


def display_labels(datos: DataFrame, balanced: bool = False, collation: str | None = None) -> DataFrame:
    """Codes -> display labels for the charts (partial, as the charts had them):
    gender recode + first ``_`` to space; R-level recode and fixed level order (levels that
    are not listed follow in byte order, or in the order of ``collation``);
    discipline ``_`` -> space, five spelling repairs, wrap at 30 (greedy, or ``balanced``);
    three country recodes, then title case."""
    fold = wrap_balanced if balanced else wrap
    adds = {}
    if "genero" in datos.columns:
        adds["genero"] = replace_first(recode("genero", C.GENERO_RECODE), "_", " ")
    if "nivel_r" in datos.columns:
        adds["nivel_r"] = recode("nivel_r", C.NIVEL_R_RECODE)
    if "areas" in datos.columns:
        adds["areas"] = fold(replace_each_first(replace_all("areas", "_", " "), C.AREAS_REPAIRS), C.AREAS_WRAP)
    if "pais" in datos.columns:
        adds["pais"] = title_case(recode("pais", C.PAIS_RECODE))
    datos = datos.withColumns(adds) if adds else datos
    if "nivel_r" in datos.columns:
        datos = relevel_ordinal(datos, "nivel_r", C.NIVEL_R_FIRST, collation=collation)
    return datos


def codebook_labels(datos: DataFrame, codebook: DataFrame,
                    questions=("genero", "pais", "areas", "nivel_r"), collation: str | None = None) -> DataFrame:
    """Exact labels from the codebook instead of the partial hand repairs: each code
    column is replaced by its option label (unknown codes kept as they are), then the
    fixed level order of the R-level question is added."""
    from seatwise.operators.codebook import decode

    qs = [q for q in questions if q in datos.columns]
    out = decode(datos, codebook, qs, suffix="__label")
    qs = [q for q in qs if f"{q}__label" in out.columns]       # the others have no options
    if qs:
        out = out.withColumns({q: F.coalesce(F.col(f"{q}__label"), F.col(q)) for q in qs}) \
                 .drop(*[f"{q}__label" for q in qs])
    if "nivel_r" in out.columns:
        label_of = {r["option_code"]: r["option_label"] for r in
                    codebook.filter(F.col("question_id") == "nivel_r").collect()}
        out = relevel_ordinal(out, "nivel_r", [label_of.get(c, c) for c in C.NIVEL_R_FIRST], collation=collation)
    return out


def harmonise(admitted: DataFrame, applicants: DataFrame, tipo: str = "tipo",
              codebook: DataFrame | None = None, balanced: bool = False, collation: str | None = None) -> DataFrame:
    """One labelled table of both populations with display-ready labels; with a
    ``codebook`` the labels are the exact option labels.  ``balanced`` wraps the disciplines
    with least raggedness, ``collation`` orders levels in a language's order."""
    datos = stack_populations(admitted, applicants, tipo)
    if codebook is not None:
        return codebook_labels(datos, codebook, collation=collation)
    return display_labels(datos, balanced, collation)


def auto_percent_digits(df: DataFrame, p: str = "p") -> int:
    """Digits the percent labeller picks when no accuracy is given: one decimal finer
    than the smallest gap between distinct percent values, less one when that last digit
    would be 0 in all of them, never coarser than whole percents (0 digits); one distinct
    value gives 0.  Runs on a chart table (one row per level), so the scalars that come
    back are all that reaches the driver."""
    vals = df.select((F.col(p) * 100.0).alias("v")).filter(F.col("v").isNotNull()).distinct()
    gaps = vals.withColumn("d", F.col("v") - F.lag("v").over(Window.orderBy("v")))
    # whether the last digit is 0 in all values, for each number of digits that a gap can ask for
    tried = range(0, 12)
    idle = F.array(*[F.bool_and(F.bround(F.col("v") * F.lit(10.0 ** k)) % 10 == 0) for k in tried])
    gap, idle = gaps.agg(F.min("d"), idle).first()
    if gap is None or gap < 1.4901161193847656e-08:      # sqrt(machine epsilon)
        return 0
    digits = 1 - math.floor(math.log10(gap))
    return max(0, digits - 1 if digits < 1 or idle[digits] else digits)


def _label(df: DataFrame, digits: int | str = 1) -> DataFrame:
    if digits == "auto":
        digits = auto_percent_digits(df)
    return df.withColumn("label", percent_label("p", digits))


def _reorder_other_last(c: DataFrame, col: str, other: str) -> DataFrame:
    """Order levels by share; on equal shares the lumped level comes after the others,
    as the lumping leaves it last in the level order."""
    c = c.withColumn("__other", (F.col(col) == F.lit(other)).cast("int"))
    return reorder_by(c, col, "p", prior="__other", per_level=True).drop("__other")


def _keys(datos: DataFrame, tipo: str) -> dict[str, list[str]]:
    level = ["nivel_r", "nivel_r_ord"] if "nivel_r_ord" in datos.columns else ["nivel_r"]
    keys = {"gender": ["genero"], "lgbt": ["lgbt"], "level": level, "areas": ["areas"], "countries": ["pais"]}
    return {chart: [*ks, tipo] for chart, ks in keys.items() if all(k in datos.columns for k in ks)}


def chart_counts(datos: DataFrame, tipo: str = "tipo") -> DataFrame:
    """The counts behind all charts but the density, from one scan of ``datos``: a stored table
    of a row per chart, level and population.  Every further step of a chart runs on it."""
    return stored(count_tables(datos, _keys(datos, tipo)))


def _counts(datos: DataFrame, tipo: str, chart: str, counts: DataFrame | None) -> DataFrame:
    """The stored counts of one chart: those of ``chart_counts``, or counted here."""
    keys = _keys(datos, tipo)[chart]
    if counts is None:
        return stored(count_by(datos, keys, ordered=False))
    return counts.filter(F.col("table") == chart).select(*keys, "n")


def gender_share(datos: DataFrame, tipo: str = "tipo", counts: DataFrame | None = None) -> DataFrame:
    c = keep_in(_counts(datos, tipo, "gender", counts), "genero", C.GENDER_CHART_LEVELS)
    return _label(share_within(c, tipo), "auto")


def lgbt_share(datos: DataFrame, tipo: str = "tipo", counts: DataFrame | None = None) -> DataFrame:
    c = filter_out(_counts(datos, tipo, "lgbt", counts), F.col("lgbt") == C.LGBT_CHART_DROP)
    return _label(share_within(c, tipo), "auto")


def level_count(datos: DataFrame, tipo: str = "tipo", counts: DataFrame | None = None) -> DataFrame:
    keys = [k for k in ("nivel_r", tipo, "nivel_r_ord") if k in datos.columns]
    return share_within(_counts(datos, tipo, "level", counts), tipo).select(*keys, "n", "p")


def top_areas_share(datos: DataFrame, tipo: str = "tipo", counts: DataFrame | None = None) -> DataFrame:
    c = _counts(datos, tipo, "areas", counts).filter(F.col(tipo) == C.TIPO_ADMITTED)
    c = lump_counts(c, "areas", C.AREAS_TOP, C.AREAS_OTHER).withColumn(tipo, F.lit(C.TIPO_ADMITTED))
    return _label(_reorder_other_last(share_of_total(c.select("areas", tipo, "n")), "areas", C.AREAS_OTHER))


def age_density(datos: DataFrame, tipo: str = "tipo", points: int = 512) -> DataFrame:
    adm = datos.filter(F.col(tipo) == C.TIPO_ADMITTED)
    return density(adm, "edad", points=points)


def top_countries_share(datos: DataFrame, tipo: str = "tipo", counts: DataFrame | None = None) -> DataFrame:
    c = _counts(datos, tipo, "countries", counts).filter(F.col(tipo) == C.TIPO_ADMITTED)
    c = lump_counts(c, "pais", C.PAIS_TOP, C.PAIS_OTHER)
    return _label(_reorder_other_last(share_of_total(c), "pais", C.PAIS_OTHER))


def chart_tables(datos: DataFrame, tipo: str = "tipo") -> dict[str, DataFrame]:
    """All six chart tables; five of them come from one scan of ``datos``."""
    counts = chart_counts(datos, tipo)
    return {
        "gender": gender_share(datos, tipo, counts),
        "lgbt": lgbt_share(datos, tipo, counts),
        "level": level_count(datos, tipo, counts),
        "areas": top_areas_share(datos, tipo, counts),
        "age": age_density(datos, tipo),
        "countries": top_countries_share(datos, tipo, counts),
    }
