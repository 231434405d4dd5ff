"""Counts, strict means and string collapsing.

All counts are partial + final hash aggregates (map-side combine), so a hot level
costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.convert import as_double, to_number
from seatwise.operators.sorting import collated, sort_cols


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def count_by(df: DataFrame, keys: str | Sequence[str], sort: bool = False,
             name: str = "n", ordered: bool = True, collation: str | None = None) -> DataFrame:
    """Rows per key combination; null is its own group.

    ``collation`` names the language whose order the keys follow (default: bytes); the groups
    are those of the exact texts either way, and texts that it takes as equal follow their bytes.

    Ordered by the keys ascending (nulls last), or with ``sort=True`` by ``name``
    descending then the keys.  The order is for display and runs on the aggregated
    rows; ``ordered=False`` skips it when the counts feed another step.
    """
    keys = _list(keys)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    if not ordered:
        return out
    order = sort_cols([f"-{name}"]) if sort else []
    if collation is not None:
        order += [c.asc_nulls_last() for c in (collated(out, k, collation) for k in keys)]
    return out.orderBy(*order, *sort_cols(keys))


def count_having(df: DataFrame, keys: str | Sequence[str], cond: Column,
                 name: str = "n") -> DataFrame:
    """``count_by`` then a filter; Catalyst pushes key-only predicates below the aggregate."""
    return count_by(df, keys, name=name, ordered=False).filter(cond)


def mean_strict(df: DataFrame, col: str | Column, by: str | Sequence[str] = (),
                na_rm: bool = False, name: str = "mean") -> DataFrame:
    """Mean of a number held as text; any null (or non-number) makes it null unless
    ``na_rm``.  With no rows the mean is null."""
    x = as_double(df, col) if isinstance(col, str) else to_number(col)
    avg = F.avg(x)
    agg = avg if na_rm else F.when(F.count(F.lit(1)) == F.count(x), avg)
    by = _list(by)
    return df.groupBy(*by).agg(agg.alias(name)) if by else df.agg(agg.alias(name))


def collapse(df: DataFrame, col: str, order: Sequence[str] | str, batch_size: int | None,
             sep: str = ", ", name: str = "recipients", batch_name: str = "batch") -> DataFrame:
    """Join a column's values into strings of at most ``batch_size`` values each; with
    ``batch_size=None`` into one string, which must fit one task.

    The values are numbered in ``order`` with the two-phase ordinal, batch ``b`` holds
    numbers ``b*batch_size+1 ..``, so no group is larger than ``batch_size`` however
    long the list.  Null becomes ``"NA"``.
    """
    from seatwise.operators.ordinal import ordinal

    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    order = _list(order)
    ranked = ordinal(df.select(col, *[o.lstrip("-") for o in order if o.lstrip("-") != col]),
                     order, name="__i")
    val = F.coalesce(F.col(col).cast("string"), F.lit("NA"))
    batch = F.lit(0).cast("long") if batch_size is None else F.floor((F.col("__i") - 1) / batch_size).cast("long")
    return (ranked.withColumn(batch_name, batch)
                  .groupBy(batch_name)
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__i"), val.alias("v")))),
                                                lambda s: s["v"]), sep).alias(name)))


def count_each(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Counts per value for several columns in ONE scan: rows ``(column, value, n)``.

    The report counts answers of many questions; separate ``count_by`` calls would
    read the table once per question.  Here each row is unpivoted to (column, value)
    inside the task and a partial aggregate combines them before the shuffle.
    Values are compared as text; null is its own value.
    """
    cols = list(cols)
    kv = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    return (df.select(kv.alias("kv")).select("kv.column", "kv.value")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias(name)))


def count_tables(df: DataFrame, tables: Mapping[str, Sequence[str]], aggs: Mapping[str, Column] | None = None,
                 label: str = "table", name: str = "n") -> DataFrame:
    """Several count tables from ONE scan, as one table: ``label``, every key column (null
    where a table has not that key), ``name`` and the further aggregates ``aggs``.

    ``tables`` maps a table's name to its keys; without keys it is the row of the whole table.
    The key sets become one aggregate with grouping sets.  Each row is repeated per set inside
    the task and met by the partial aggregate there, so what is shuffled is one row per level
    and task.  The grouping id tells a table's null level from the null of a key it has not.
    """
    cols = list(dict.fromkeys(k for keys in tables.values() for k in keys))
    tables_of: dict[int, list[str]] = {}
    for t, keys in tables.items():
        # the id has a bit per column, the first one highest, set where the column is no key
        tables_of.setdefault(sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in keys), []).append(t)
    sets = [[F.col(c) for i, c in enumerate(cols) if not bits >> (len(cols) - 1 - i) & 1] for bits in tables_of]
    aggs = [F.count(F.lit(1)).alias(name), *[a.alias(k) for k, a in (aggs or {}).items()]]
    if not cols:
        out = df.agg(*aggs).withColumn("__gid", F.lit(0))
    else:
        out = df.groupingSets(sets, *[F.col(c) for c in cols]).agg(*aggs, F.grouping_id().alias("__gid"))
    names = None
    for bits, ts in tables_of.items():
        here, value = F.col("__gid") == bits, F.array(*[F.lit(t) for t in ts])
        names = F.when(here, value) if names is None else names.when(here, value)
    out = out.select(F.explode(names).alias(label), *cols, *[c for c in out.columns if c not in (*cols, "__gid")])
    return out
