"""A corpus pipeline of five stages over the documents table; each works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonarium.llm import common as C
from zonarium.llm.decontamination import without_benchmarks
from zonarium.llm.language_id import keep_identified
from zonarium.llm.mixing import sample_mixture
from zonarium.llm.sharding import assign_shards
from zonarium.llm.simhash import one_of_each

#: Bytes of text in a shard of the last stage.
SHARD_BYTES = 1 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; lang becomes the predicted one."""
    return keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return without_benchmarks(docs, C.read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have flattened token shares."""
    return sample_mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document that is left."""
    return assign_shards(docs, SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No stage but the last can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
