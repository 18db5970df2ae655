"""A corpus pipeline of five stages. Each stage reads what the one before wrote.

The weights, thresholds and seeds are those of the single queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import queries as q
from quernstone.llm.common import settled, table
from quernstone.llm.op01_mix import mix
from quernstone.llm.op03_nearjoin import keep_one
from quernstone.llm.op05_shard import place_rows
from quernstone.llm.op08_quality import held_out, keep_good, train
from quernstone.llm.op10_decontaminate import decontaminate


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    weights = train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return keep_good(docs, weights, q.QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies."""
    return keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole or edited."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), q.LEAK_SCORE)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their target weights."""
    return mix(docs, q.MIX_WEIGHTS, q.MIX_SHARE, q.MIX_MOST, q.MIX_SEED)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard and slot of each row."""
    return place_rows(docs, q.SHARDS)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", benchmark_filter),
    ("mixing sources", source_mix),
    ("sharding", sharding),
]

#: SQL can express neither the classifier nor the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
