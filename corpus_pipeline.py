"""The corpus pipeline: the stages that turn raw documents into training shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's documents.  A stage begins by releasing what the ones before it
left on the driver and on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm import decontamination, mixing, neardup, sharding, toxicity
from seatwise.llm.common import release, table
from seatwise.llm.queries import SHARDS
from seatwise.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    release(spark)
    net = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    own = {f"c{i}": c for i, c in enumerate(docs.columns)}      # an extra column may have any name, also with a dot
    text = next(k for k, c in own.items() if c == "text")
    scored = toxicity.score_toxicity(docs.toDF(*own), net, text)
    return scored.filter("predicted = 0").select(*own).toDF(*own.values())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    release(spark)
    return neardup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    release(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document taken more than once is repeated, one not taken goes."""
    release(spark)
    return mixing.take_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and its slot there."""
    release(spark)
    return sharding.shard_plan(docs, SHARDS).select(F.col("row_id").alias("doc_id"), "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]

ORACLE_SQL = None      # trained models, hashing and packing are beyond SQL: see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
