"""Sort specs with the null placement of the intake scripts: null LAST both ways.

A spec is a column name, ``"x"`` ascending or ``"-x"`` descending.  Spark's default
puts nulls first when ascending, so every sort here goes through this helper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SortSpec = str


def _parse(spec: SortSpec) -> tuple[str, bool]:
    return (spec[1:], False) if spec.startswith("-") else (spec, True)


def collated(df: DataFrame, col: str, collation: str | None) -> Column:
    """``col`` for ordering in a language's order: texts under ``collation`` (``"es"``: ``ñ``
    between ``n`` and ``o``, ``á`` next to ``a``), other types and ``None`` as they are (texts
    by their bytes, which puts every accented letter behind ``z``)."""
    if collation is None or not isinstance(df.schema[col].dataType, T.StringType):
        return F.col(col)
    return F.collate(F.col(col), collation)


def sort_cols(specs: Sequence[SortSpec] | SortSpec, reverse: bool = False) -> list[Column]:
    """Sort columns for ``specs``; ``reverse`` flips direction and null placement."""
    specs = [specs] if isinstance(specs, str) else list(specs)
    out = []
    for s in specs:
        name, asc = _parse(s)
        if not reverse:
            out.append(F.asc_nulls_last(name) if asc else F.desc_nulls_last(name))
        else:
            out.append(F.desc_nulls_first(name) if asc else F.asc_nulls_first(name))
    return out
