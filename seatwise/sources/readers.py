"""Readers for the inputs of the intake jobs.

* responses: a JDBC table read in parallel ranges, or a parquet dataset;
* snapshots: parquet;
* ``;``-separated CSV with comma decimals (and ``.`` thousands marks);
* line lists: one key per line (column ``value``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMA_NUMBER = (r"^\s*-?([0-9]{1,3}(\.?[0-9]{3})*|[0-9]+)(,[0-9]+)?([eE][-+]?[0-9]+)?\s*$")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower_bound: int | str, upper_bound: int | str, num_partitions: int,
              properties: dict[str, str] | None = None, fetch_size: int = 10_000) -> DataFrame:
    """Response table over JDBC, split into ``num_partitions`` ranges of a numeric or
    timestamp column so the read runs in parallel (simple filters are pushed down)."""
    return (spark.read.format("jdbc")
            .option("url", url).option("dbtable", table)
            .option("partitionColumn", partition_column)
            .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
            .option("numPartitions", str(num_partitions))
            .option("fetchsize", str(fetch_size))
            .options(**(properties or {}))
            .load())


def comma_decimal(col) -> F.Column:
    """``"1.234,5"`` -> 1234.5; null when not a number."""
    c = col if isinstance(col, F.Column) else F.col(col)
    return F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".").try_cast("double")


# what a column of texts may be typed as, in this order; every non-null value must match
_TYPES = [
    ("boolean", r"^(TRUE|FALSE|true|false)$", lambda c: c.cast("boolean")),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", lambda c: c.try_cast("date")),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?Z?$",
     lambda c: c.try_cast("timestamp")),
    ("long", r"^\s*-?([0-9]{1,18}|[0-9]{1,3}(\.[0-9]{3}){1,5})\s*$",
     lambda c: F.regexp_replace(F.trim(c), r"\.", "").try_cast("long")),
    ("double", COMMA_NUMBER, comma_decimal),
]


def read_csv2(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              decimal_cols: Sequence[str] | None = None, na: str = "NA",
              multiline: bool = True) -> DataFrame:
    """``;``-separated CSV with a header, ``NA`` for missing, comma decimals and ``.`` as
    the thousands mark.

    With a ``schema``, string columns listed in ``decimal_cols`` are converted.  Without
    one, everything is read as text and one aggregate pass types the columns: a column is
    a boolean, date, timestamp, whole number or number when all its values are.

    Fields may hold line breaks, so a file is read by one task (write many files);
    ``multiline=False`` splits files and is for data known to have none.
    """
    # Quotes inside quoted fields are doubled (RFC 4180, as R writes them).
    r = (spark.read.option("sep", ";").option("header", True).option("nullValue", na)
         .option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
         .option("multiLine", multiline))
    if schema is not None:
        df = r.schema(schema).csv(path)
        strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        return df.withColumns({c: comma_decimal(c) for c in decimal_cols or () if c in strings})
    df = r.csv(path)
    fits = {(i, k): F.bool_and(F.col(f"`{c}`").rlike(pattern)) for i, c in enumerate(df.columns)
            for k, (_, pattern, _) in enumerate(_TYPES)}
    flags = df.agg(*[F.coalesce(f, F.lit(False)).alias(f"{i}_{k}") for (i, k), f in fits.items()]).first() if fits else {}
    typed = {}
    for i, c in enumerate(df.columns):
        if decimal_cols is not None and c in decimal_cols:
            typed[c] = comma_decimal(F.col(f"`{c}`"))
            continue
        for k, (_, _, convert) in enumerate(_TYPES):
            if flags[f"{i}_{k}"]:
                typed[c] = convert(F.col(f"`{c}`"))
                break
    return df.withColumns(typed) if typed else df


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """One value per line, column ``value`` (blank lines kept, as read)."""
    return spark.read.text(path)
