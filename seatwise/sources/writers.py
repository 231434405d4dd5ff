"""Writers: anonymised snapshots, ``;``-CSV with comma decimals, recipient lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSONAL_COLUMNS = ("nombre", "correo")


def write_snapshot(df: DataFrame, path: str, drop: Sequence[str] = PERSONAL_COLUMNS,
                   mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` without the personal columns as parquet; returns ``path``."""
    w = df.drop(*drop).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def csv2_frame(df: DataFrame) -> DataFrame:
    """Doubles rendered with a decimal comma, the rest as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.regexp_replace(c.cast("string"), r"\.", ",").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def write_csv2(df: DataFrame, path: str, mode: str = "overwrite", na: str = "NA") -> str:
    """``;``-separated CSV with a header, comma decimals and ``NA`` for missing."""
    (csv2_frame(df).write.mode(mode).option("sep", ";").option("header", True)
        .option("nullValue", na).option("emptyValue", "").option("quote", '"').option("escape", '"')
        .csv(path))
    return path


def write_text_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> str:
    """One line per row of ``col`` (e.g. the batches of a recipient list)."""
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)
    return path
