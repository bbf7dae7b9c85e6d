"""From raw documents to dealt training data, in five stages over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import cut
from lexmill.llm.decontamination import decontaminate
from lexmill.llm.mixing import mixed
from lexmill.llm.near_copies import without_near_copies
from lexmill.llm.sharding import shard_documents
from lexmill.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the model of the labelled ones predicts to be toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id (links: SimHash fingerprints in a trie self-join, and MinHash bands for what these miss; each verified, a similarity of the sets of five-word shingles of 0.8 or more)."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a near copy of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics have tempered shares of the tokens."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals what is left to eight shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: A conditional random field, k-means topics and sampled near copies are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
