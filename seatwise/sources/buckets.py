"""Snapshots in buckets: later joins and first-per-key on the bucket key need no shuffle.

Rows are dealt by the key's hash once, when the snapshot is written, with one sorted file per
bucket.  Tables written with the same number of buckets on the same key then join, semi-join,
group and rank bucket by bucket.  The definition lives in the session's catalogue;
``register_buckets`` defines a written folder again in another session.

A bucket is read by one task, so a key with a third of all rows makes a task of that size: use
buckets for keys that are near unique (people, ids) and ``first_per_key`` on plain
tables for others.  ``buckets`` should leave a bucket at a few hundred MiB.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _names(columns: Sequence[str]) -> str:
    return ", ".join("`" + c.replace("`", "``") + "`" for c in columns)


def write_bucketed(df: DataFrame, table: str, path: str, by: str, buckets: int, sort_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to ``path`` as ``buckets`` files by the hash of ``by``, sorted by ``by``
    and ``sort_by``, and return it as the table ``table``."""
    order = [by, *sort_by]
    (df.repartition(buckets, f"`{by}`").write.format("parquet").bucketBy(buckets, by).sortBy(*order)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def register_buckets(spark: SparkSession, table: str, path: str, by: str, buckets: int, sort_by: Sequence[str] = ()) -> DataFrame:
    """The folder ``path`` that ``write_bucketed`` wrote, as the table ``table`` of this session."""
    columns = ", ".join(f"{_names([f.name])} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE {_names(table.split('.'))} ({columns}) USING parquet "
              f"CLUSTERED BY ({_names([by])}) SORTED BY ({_names([by, *sort_by])}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)
