"""From documents to a sharded training corpus; every stage works on what the one before kept.

Quality rules, one document of each group of near duplicates, no benchmark passages, sources
mixed to target weights, shards, where documents that share sentences are kept together.  Each
stage is written as Parquet and read again.

Nulls, empty and long texts, repeated rows and ties are treated as the stages' operators state in
their docstrings; further columns go along to the last stage, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cdcgold.llm import decontaminate, jaccard, mixing, quality, sharding
from cdcgold.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_rows(docs, miss=mixing.MISS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # equal texts are gone by now; what still links documents is sentences that they share
    return sharding.assign(docs, hubs=sharding.sentences())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("no_benchmark", no_benchmark),
    ("mix", mix),
    ("shards", shards),
]

#: Suffix arrays, the join and the fitting have no plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
