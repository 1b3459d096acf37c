"""The operators as queries over whole given tables, and SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_counts, hamming, katz, merge_encoding, merkle, ngram_rules, norm_buckets, oracles, packing, ranking, resharding, severity, sketch, skip_chain

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return severity.score(documents, severity.train(documents, table(spark, folder, "labels")))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_pairwise_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return ranking.score(documents, ranking.train(documents, table(spark, folder, "labels")))


def op4_multi_index_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return hamming.near_duplicates(table(spark, folder, "documents"))


def op5_skip_chain_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return skip_chain.found_spans(documents, skip_chain.train(documents))


def op6_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(table(spark, folder, "documents"))


def op7_merge_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return merge_encoding.encode_decode(table(spark, folder, "documents"), public_tokenizers.path(PIECE_BPE))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_ngram_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.compare_with_edits(table(spark, folder, "documents"))


def op11_norm_bucket_search(spark: SparkSession, folder: str) -> DataFrame:
    return norm_buckets.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_butterfly_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tampered_documents(table(spark, folder, "documents"))


def op13_flow_resharding(spark: SparkSession, folder: str) -> DataFrame:
    return resharding.reshard(table(spark, folder, "documents"), resharding.by_source())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_toxicity": op1_ordinal_toxicity,
    "op2_packing": op2_packing,
    "op3_pairwise_quality": op3_pairwise_quality,
    "op4_multi_index_simhash": op4_multi_index_simhash,
    "op5_skip_chain_pii": op5_skip_chain_pii,
    "op6_katz_backoff": op6_katz_backoff,
    "op7_merge_encoding": op7_merge_encoding,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_quality_rules": op9_ngram_quality_rules,
    "op10_scaled_sketch": op10_scaled_sketch,
    "op11_norm_bucket_search": op11_norm_bucket_search,
    "op12_butterfly_manifest": op12_butterfly_manifest,
    "op13_flow_resharding": op13_flow_resharding,
}

ORACLES: dict[str, str] = {
    "op9_ngram_quality_rules": oracles.NGRAM_QUALITY_RULES,
    "op11_norm_bucket_search": oracles.NORM_BUCKET_SEARCH,
    "op12_butterfly_manifest": oracles.BUTTERFLY_MANIFEST,
}
