"""Five stages that make a training corpus of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkshelf.checkpoints import shared_folder
from sparkshelf.llm import decontamination, mixing, neardup, sharding, toxicity
from sparkshelf.shipping import ship

SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.drop_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of five-word shingles, similarity of 0.8 or more."""
    ship(spark)
    return neardup.drop_near_duplicates(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.decontaminate(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; files, and rows in each, lie in the order of the mix's shards and inside them in its random order."""
    ship(spark)
    mixed = mixing.mixed_rows(docs, SHARDS)
    shard, order = mixed.columns[-2:]
    mixed = mixed.repartitionByRange(shard, order).sortWithinPartitions(shard, order)
    return mixed.select(*[f"`{c}`" for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and each row's shard by its doc_id, with the one it would have among one shard more."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: SQL can't express these stages; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared checkpoint folder and read again."""
    top = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
