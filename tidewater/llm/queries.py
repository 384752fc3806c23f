"""The queries of this folder, with DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontamination, exact_search, html_extraction, jaccard_join, language_id, mixing, secret_scan, sharding, token_counts, token_files
from tidewater.llm.session import read

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_back(token_files.write(read(spark, sf_dir, "documents"), vocabulary(TOKENIZER)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 16)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"), vocabulary(PIECES))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.annotate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"]))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), vocabulary(PIECES))


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(read(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"), vocabulary(PIECES))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_files, op2_sharding, op3_language_id, op4_decontamination, op5_jaccard_join, op6_html_extraction, op7_token_counts, op8_exact_search, op9_secret_scan, op10_mixing,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_search": exact_search.ORACLE, "op10_mixing": mixing.ORACLE}
