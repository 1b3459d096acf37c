"""A training corpus from raw documents: keep good documents, one of each group of near-duplicates, mask, pack.

Each stage reads what the one before it wrote and takes (spark, documents, folder of the tables). All but the last
return the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import hamming, ngram_rules, packing, ranking, skip_chain
from ledgerspark.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the pairwise ranking accepts."""
    return ranking.accepted(docs, ranking.train(docs, labels(spark, sf_dir)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that pass the plain rules and the n-gram ratio."""
    return ngram_rules.kept_documents(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of fingerprints that are linked at 2 or fewer differing bits."""
    return hamming.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: texts with personal data masked."""
    return skip_chain.masked(docs, skip_chain.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents tokenised, cut and packed into sequences."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted model, SimHash and a tokenizer are beyond SQL; tests/llm compares the stages with plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Every stage is written and read again, so a lost executor costs one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
