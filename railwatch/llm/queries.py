"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railwatch.llm import (
    ann,
    byte_bpe,
    exact_search,
    language_id,
    lexical_search,
    mixing,
    oracles,
    packing,
    quality,
    simhash,
    substring_dedup,
    token_counts,
    url_filter,
    whitening,
)
from railwatch.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexadecimal = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return linked.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.MAX_TOKENS)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_products(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    hashes = {"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}
    return byte_bpe.decode(encoded, ranks).withColumns(hashes).drop("ids", "decoded")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    jobs = (
        op1_substring_dedup,
        op2_url_filters,
        op3_best_fit_packing,
        op4_simhash_near_dedup,
        op5_nearest_neighbours,
        op6_token_counts,
        op7_quality_classifier,
        op8_source_mixing,
        op9_exact_top_k,
        op10_language_id,
        op11_byte_bpe,
        op12_lexical_search,
        op13_embedding_whitening,
    )
    return {job.__name__: job for job in jobs}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op9_exact_top_k": oracles.EXACT_TOP_K,
        "op12_lexical_search": oracles.LEXICAL_SEARCH,
    }
