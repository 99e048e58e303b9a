"""A training corpus from `documents` in five stages, each stored as Parquet and read back as the next one's documents.

In every stage, whatever columns are null: null text counts as empty, null ids and sources are values like others, repeated rows are
rows of their own, ties are broken by the rows' values, texts of any length are taken whole, further columns of docs are carried along (the last
stage replaces those of its own names), and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteleaf.llm import decontaminate, mixing, ngram_join, quality_model, sharding
from graniteleaf.llm.common import stored, table

N_SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go; repeated rows alike. Without usable labels (nulls count as none) all score 0.5 and stay."""
    scored = quality_model.scored(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles at 0.8 connect, one document stays: the one of least id (null ids last).

    Of rows alike in words and id one stays. Blank and null texts are one group.
    """
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each of repeated rows too. Null and blank texts and items match nothing; without items all stay."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document stands as often as the schedule reads it.

    A null source is a source of its own. Documents without words are read with the block at their place.
    """
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; a null source is a stratum of its own, fewer rows than shards leave the last ones empty."""
    return sharding.shard(docs, N_SHARDS, carry=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("sharded", sharded)]
#: Random features, minhashes and latent directions cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).drop("grown_shard")
