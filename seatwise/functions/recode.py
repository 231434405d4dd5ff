"""Recode listed values, keep the rest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

CASE_MAX = 32   # above this many pairs, one hash-map literal instead of a CASE chain


def recode(col, mapping: Mapping[str, str]) -> Column:
    """Map the listed values, keep every other value (and null) as it is.

    A handful of pairs becomes a ``CASE`` chain inside whole-stage codegen; a longer
    map becomes one map literal looked up per row (constant code size, hash lookup).
    The map travels with the plan, so it should be a code list, not a table - a
    table-sized mapping belongs in a broadcast join (``operators.codebook``).
    """
    c = col if isinstance(col, Column) else F.col(col)
    if not mapping:
        return c
    if len(mapping) > CASE_MAX:
        m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return F.when(c.isNotNull() & F.map_contains_key(m, c), F.try_element_at(m, c)).otherwise(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(c)
