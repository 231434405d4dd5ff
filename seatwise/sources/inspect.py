"""Inspection: schema with sample values, and a per-column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def glimpse(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """One row per column: name, type, the first ``n`` values as text.

    Spark rows have no order: pass ``order`` (sort specs) for a repeatable sample.
    Only ``n`` rows reach the driver.
    """
    from seatwise.operators.ordinal import head_rows

    spark = df.sparkSession
    sample = (head_rows(df, order, n) if order else df.limit(n)).collect()
    rows = [(f.name, f.dataType.simpleString(),
             ", ".join("NA" if r[f.name] is None else str(r[f.name]) for r in sample))
            for f in df.schema.fields]
    return spark.createDataFrame(rows, "column string, type string, sample string")


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: rows, non-null values, distinct non-null values.

    One pass: every column is cast to text and unpivoted to (column, value); the
    distinct count is a two-level aggregate keyed by (column, value) first, so a value
    repeated in a third of the rows is combined inside each task.  ``approx=True``
    uses HyperLogLog sketches instead (bounded memory per column).
    """
    cols = df.columns
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value")
    distinct = F.approx_count_distinct("value") if approx else F.count_distinct("value")
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"),
                                      F.count("value").alias("n_non_null"),
                                      distinct.alias("n_distinct"))
