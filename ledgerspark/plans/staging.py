"""Typed staging frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerspark.functions.amounts import parse_us_date, signed_amount
from ledgerspark.functions.text import clean_text

LINEAGE = ["source_row_number", "source_file", "source_mode", "ingested_at"]


def stage_transactions(raw: DataFrame) -> DataFrame:
    """Rename, type and flag raw export rows in one projection."""
    money = signed_amount(F.col("Amount"))
    return raw.select(
        F.col("row_hash").alias("transaction_id"),
        parse_us_date(F.col("Transaction Date")).alias("transaction_date"),
        parse_us_date(F.col("Post Date")).alias("post_date"),
        F.col("Description").alias("raw_description"),
        clean_text(F.col("Description")).alias("clean_description"),
        F.col("Category").alias("raw_category"),
        F.col("Type").alias("transaction_type"),
        *[column.alias(name) for name, column in money.items()],
        F.col("Memo").alias("memo"),
        *LINEAGE,
    )


def stage_descriptions(raw: DataFrame) -> DataFrame:
    """The distinct descriptions of raw export rows, typed as their transactions are; each is cleaned once."""
    text = F.col("Description")
    return raw.select(text).distinct().select(text.alias("raw_description"), clean_text(text).alias("clean_description"))


def stage_enrichments(cache: DataFrame) -> DataFrame:
    return cache.select(
        "raw_description",
        "suggested_merchant",
        "suggested_category",
        "suggested_merchant_group",
        "confidence",
        "reasoning",
        "model",
        "created_at",
    )
