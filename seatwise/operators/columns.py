"""Column-set operators: drop by prefix, align to another table, relocate, across."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_prefix_keep(df: DataFrame, prefix: str, keep: Iterable[str] = (),
                     drop: Iterable[str] = ()) -> DataFrame:
    """Drop every column starting with ``prefix`` but re-add ``keep`` at the end, and
    drop ``drop``.  ``keep`` columns move to the end, in the order given."""
    keep, drop = list(keep), set(drop)
    head = [c for c in df.columns if not c.startswith(prefix) and c not in drop and c not in keep]
    return df.select(*head, *[c for c in keep if c in df.columns])


def select_any_of(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep the columns of ``names`` that ``df`` has, in the order of ``names``."""
    have = set(df.columns)
    return df.select(*[c for c in names if c in have])


def relocate_after(df: DataFrame, col: str, after: str) -> DataFrame:
    """Move ``col`` right after ``after``."""
    rest = [c for c in df.columns if c != col]
    i = rest.index(after) + 1
    return df.select(*rest[:i], col, *rest[i:])


def across_strings(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every string column in one projection (names and order kept)."""
    return df.select(*[
        fn(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def add_constant(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant column; an int literal becomes a double like an R numeric."""
    v = float(value) if isinstance(value, int) and not isinstance(value, bool) else value
    return df.withColumn(name, F.lit(v))
