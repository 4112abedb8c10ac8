"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(C.read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_classes

    return simhash_classes(C.read_table(spark, sf_dir, "documents"))


@query
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_shards

    return token_shards(C.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(C.read_table(spark, sf_dir, "documents"))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(C.read_table(spark, sf_dir, "pages"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminations

    return contaminations(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark"))


#: Bytes of text in a shard of op10_sharding.
SHARD_BYTES = 1 << 20


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(C.read_table(spark, sf_dir, "documents"), SHARD_BYTES)


def _sharding_oracle() -> str:
    from .sharding import oracle

    return oracle(SHARD_BYTES)


ORACLE["op10_sharding"] = _sharding_oracle()


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(C.read_table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(C.read_table(spark, sf_dir, "documents"))


@query
def op1_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passage_dedup import passage_classes

    return passage_classes(C.read_table(spark, sf_dir, "documents"))
