"""Stored column profiles that merge: one row per column, kept beside a snapshot.

``build_profile`` reads the rows once and makes one wide partial aggregate: each task sends
one row of counts and sketches, no cell becomes a row of its own.  ``merge_profiles`` adds up
profiles of disjoint row sets (days, partitions, appended snapshots) without their rows.

Exact: rows, non-null values, least and greatest text (byte order), least and greatest number.
Sketched: distinct values (HyperLogLog of ``2 ** LG_K`` registers, relative standard error
``1.04 / sqrt(2 ** LG_K)``, 0.8 %) and quantiles of numeric columns (KLL, rank error below
1 % with ``KLL_K``).  Sketches of another ``lg_k`` are not merged but rejected by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_K = 14
KLL_K = 800
FIELDS = ["column", "n", "n_non_null", "least", "greatest", "least_number", "greatest_number", "distinct_sketch", "quantile_sketch"]


def build_profile(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None, lg_k: int = LG_K,
                  kll_k: int = KLL_K) -> DataFrame:
    """One row per column of ``df`` (per group of ``by``): ``FIELDS`` after the keys.

    Without ``by`` an empty table has rows with ``n = 0`` and null sketches of no values count
    as 0 distinct.  Doubles that are not a number are values, but not in the quantiles."""
    names = list(columns or [c for c in df.columns if c not in by])
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        text = col.cast("string")
        if isinstance(types[c], T.NumericType):
            number = col.cast("double")
            number = F.when(~F.isnan(number), number)
            numeric = [F.min(number), F.max(number), F.kll_sketch_agg_double(number, kll_k)]
        else:
            numeric = [F.lit(None).cast("double")] * 2 + [F.lit(None).cast("binary")]
        fields = [F.lit(c), F.count(F.lit(1)), F.count(col), F.min(text), F.max(text), *numeric[:2],
                  # by hash: the sketch itself passes over an empty text
                  F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(text)), lg_k), numeric[2]]
        aggs.append(F.struct(*[f.alias(n) for f, n in zip(fields, FIELDS)]).alias(f"p{i}"))
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[F.col(f"p{i}") for i in range(len(names))])).alias("p")).select(*by, "p.*")


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of all rows behind ``profiles``, per group of ``by``."""
    return profiles.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.sum("n_non_null").alias("n_non_null"), F.min("least").alias("least"),
        F.max("greatest").alias("greatest"), F.min("least_number").alias("least_number"),
        F.max("greatest_number").alias("greatest_number"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch")).select(*by, *FIELDS)


def read_profile(profile: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A profile as a report: exact columns, ``n_distinct`` (estimate) and ``quantiles`` (null
    where a column has no number)."""
    keys = [c for c in profile.columns if c not in FIELDS]
    ranks = F.array(*[F.lit(float(p)) for p in probabilities])
    numbers = F.col("least_number").isNotNull()
    return profile.select(
        *keys, *FIELDS[:7], F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).cast("long").alias("n_distinct"),
        F.when(numbers, F.kll_sketch_get_quantile_double("quantile_sketch", ranks)).alias("quantiles"))
