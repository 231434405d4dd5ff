"""Profile report of a cleaned or admitted table.

All count tables and the strict mean come from one scan (``report_counts``): a report on a
large table costs one pass for its tables, and one for each listing of whole rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.functions.convert import as_double
from seatwise.operators.counts import collapse, count_tables
from seatwise.operators.ordinal import head_rows, ordinal, tail_rows
from seatwise.operators.sorting import sort_cols
from seatwise.session import stored

# name, keys, and whether the most frequent level comes first
REPORT = (
    ("by_gender", ("genero",), False), ("by_country", ("pais",), True), ("by_level", ("nivel_r",), False),
    ("by_programming", ("nivel_programacion",), False), ("by_trans", ("trans",), False),
    ("by_education", ("educacion",), True), ("by_area", ("areas",), True), ("mean_age", (), False),
    ("country_trans", ("pais", "trans"), False),
)
LEVELS_OF_ALL_ANSWERS = ("genero", "pais", "nivel_r", "nivel_programacion", "trans", "educacion", "areas")


def report_counts(df: DataFrame, yes: str = "sí", number: str = "edad", tables=REPORT) -> DataFrame:
    """The count tables of a report as one, from one scan: ``table``, the key columns, ``n``,
    ``mean`` (of the whole-table row: the strict mean of ``number``, null if any answer is no
    number) and ``place``, the row's place in the printed report.  ``country_trans`` holds the
    levels with the answer ``yes`` only."""
    cols = list(dict.fromkeys(k for _, keys, _ in tables for k in keys))
    x = F.col("__x")
    strict = F.when(F.count(F.lit(1)) == F.count(x), F.avg(x))
    out = count_tables(df.select(*cols, as_double(df, number).alias("__x")), {t: keys for t, keys, _ in tables}, {"mean": strict})
    whole = [t for t, keys, _ in tables if not keys]
    out = out.withColumn("mean", F.when(F.col("table").isin(whole), F.col("mean")))
    if "trans" in cols:
        out = out.filter((F.col("table") != "country_trans") | F.coalesce(F.col("trans") == yes, F.lit(False)))
    number_of = F.create_map(*[F.lit(v) for i, (t, _, _) in enumerate(tables) for v in (t, i)])
    falling = [t for t, _, most_first in tables if most_first]
    out = out.withColumns({"__table": number_of[F.col("table")], "__most": F.when(F.col("table").isin(falling), -F.col("n"))})
    return ordinal(out, ["__table", "__most", *cols], name="place").drop("__table", "__most")


def profile_report(df: DataFrame, yes: str = "sí", country: str = "chile") -> dict[str, DataFrame]:
    """The tables printed by the selection script, as DataFrames (no row cut).  The count
    tables are read from one stored result of ``report_counts``."""
    tables = [(t, keys, most) for t, keys, most in REPORT if all(k in df.columns for k in keys)]
    counts = stored(report_counts(df, yes, tables=tables))
    of = lambda t: counts.filter(F.col("table") == t).orderBy("place")
    out = {t: of(t).select(*keys, "n") if keys else of(t).agg(F.max("mean").alias("mean")) for t, keys, _ in tables}
    single = {keys[0]: t for t, keys, _ in tables if len(keys) == 1}
    every = None
    for c in LEVELS_OF_ALL_ANSWERS:
        if c in single:
            part = of(single[c]).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "n")
            every = part if every is None else every.unionByName(part)
    out |= {
        # whole rows of three listings: one country, one answer, the oldest first
        "from_country": df.filter(F.col("pais") == country),
        "trans_yes": df.filter(F.col("trans") == yes),
        "by_age": df.orderBy(*sort_cols(["-edad"])),
        # every question's counts, long format (column, value, n)
        "all_answers": every,
    }
    if "puntaje" in df.columns:
        cols = [c for c in ["nombre", "pais", "genero", "disca", "trans", "lgbt", "puntaje"] if c in df.columns]
        out["listing"] = df.select(*cols).orderBy(*sort_cols(["-puntaje"]))
    if "id" in df.columns:
        cols = [c for c in ["nombre", "puntaje", "id"] if c in df.columns]
        out["head"] = head_rows(df.select(*cols), ["id"])
        out["tail"] = tail_rows(df.select(*cols), ["id"])
    return out


def recipient_list(df: DataFrame, batch_size: int | None, col: str = "correo",
                   order: str | list[str] = "id", sep: str = ", ") -> DataFrame:
    """E-mail addresses joined by ``sep`` in batches of at most ``batch_size``, or with
    ``batch_size=None`` in one string."""
    return collapse(df, col, order, batch_size, sep=sep)
