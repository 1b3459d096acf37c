"""Per-transaction features, recurrence and the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark.functions.amounts import day_gap, null_safe_zscore
from ledgerspark.functions.rules import anomaly_flag, cadence_label, final_category, recurrence_rule
from ledgerspark.operators.aggregates import deviation, mean
from ledgerspark.operators.joins import composite_left_join, null_safe_left_join
from ledgerspark.operators.windows import group_stats, lag_from_previous, previous_dates

FACT_COLUMNS = [
    "transaction_id",
    "transaction_date",
    "post_date",
    "raw_description",
    "normalized_merchant",
    "merchant_group",
    "merchant_source",
    "category_source",
    "ai_confidence",
    "ai_reasoning",
    "raw_category",
    "final_category",
    "transaction_type",
    "amount",
    "amount_abs",
    "is_debit",
    "is_credit",
    "is_recurring",
    "is_anomaly",
    "anomaly_reason",
    "zscore_vs_merchant",
    "zscore_vs_category",
]


def with_final_category(normalized: DataFrame) -> DataFrame:
    category = final_category(F.col("rule_category"), F.col("ai_category"), F.col("raw_category"))
    return normalized.withColumn("final_category", category).drop("rule_category")


def category_stats(normalized: DataFrame) -> DataFrame:
    """Mean and deviation of the amounts of each final category; a few rows, worth storing once."""
    return group_stats(with_final_category(normalized), "final_category", "amount_abs", "category")


def transaction_features(normalized: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Merchant and category statistics, z-scores and the gap to the merchant's previous transaction.

    The transactions move once, by (merchant, day). Everything a merchant contributes is first aggregated to
    one row per merchant and day, so a hot merchant does not become a single task. ``categories`` is a stored
    ``category_stats``: Catalyst knows its size, so it plans a broadcast instead of a second move of all rows.
    Transactions of one day follow each other in file order.
    """
    enriched = with_final_category(normalized)
    merchant, day, tie = "normalized_merchant", "transaction_date", "source_row_number"
    by_merchant = group_stats(enriched, merchant, "amount_abs", "merchant")
    by_category = category_stats(normalized) if categories is None else categories
    per_day = null_safe_left_join(previous_dates(enriched, merchant, day, tie), by_merchant, [merchant])
    joined = null_safe_left_join(enriched, per_day, [merchant, day])
    joined = null_safe_left_join(joined, by_category, ["final_category"])
    previous = lag_from_previous(F.col("__first"), F.col("__previous_day"), F.col(day), F.col(tie))
    dated = joined.withColumn("previous_merchant_transaction_date", previous)
    return dated.select(
        *enriched.columns,
        "merchant_avg_amount",
        "merchant_std_amount",
        "category_avg_amount",
        "category_std_amount",
        "previous_merchant_transaction_date",
        *[score.alias(name) for name, score in zscores().items()],
        day_gap(F.col("previous_merchant_transaction_date"), F.col(day)).alias(
            "days_since_last_transaction_at_merchant"
        ),
    )


def recurring_transactions(features: DataFrame) -> DataFrame:
    """Debit history per merchant and category with the recurrence verdict and cadence."""
    history = (
        features.filter("is_debit")
        .groupBy("normalized_merchant", "final_category")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.min("transaction_date").alias("first_seen"),
            F.max("transaction_date").alias("last_seen"),
            mean("amount_abs").alias("avg_amount"),
            deviation("amount_abs").alias("amount_stddev"),
            F.avg("days_since_last_transaction_at_merchant").alias("avg_days_between_transactions"),
        )
    )
    return with_verdict(history)


def with_verdict(history: DataFrame) -> DataFrame:
    """The recurrence verdict and cadence of each history row."""
    gap = F.col("avg_days_between_transactions")
    verdict = recurrence_rule(F.col("transaction_count"), gap, F.col("amount_stddev"), F.col("avg_amount"))
    return history.withColumns({"is_recurring": verdict, "cadence": cadence_label(gap)})


def recurring_keys(recurring: DataFrame) -> DataFrame:
    """The pairs of merchant and category that recur, all that the flags need: few of the pairs, so stored they are
    often small enough for Catalyst to broadcast, and the transactions stay where they are."""
    return recurring.filter("is_recurring").select("normalized_merchant", "final_category", "is_recurring")


def fact_transactions(features: DataFrame, recurring: DataFrame) -> DataFrame:
    """One row per transaction with recurrence and anomaly flags."""
    return with_flags(features, recurring).select(*FACT_COLUMNS)


def with_flags(scored: DataFrame, recurring: DataFrame) -> DataFrame:
    """Recurrence and anomaly flags of rows that have a merchant, a category and z-scores."""
    keys = ["normalized_merchant", "final_category"]
    joined = composite_left_join(scored, recurring_keys(recurring), keys)
    flags = anomaly_flag(F.col("is_debit"), F.col("zscore_vs_merchant"), F.col("zscore_vs_category"))
    return joined.withColumns({"is_recurring": F.coalesce("is_recurring", F.lit(False)), **flags})


def zscores() -> dict[str, Column]:
    """Distance of an amount from the averages of its merchant and its category, in their deviations."""
    return {
        f"zscore_vs_{of}": null_safe_zscore(F.col("amount_abs"), F.col(f"{of}_avg_amount"), F.col(f"{of}_std_amount"))
        for of in ("merchant", "category")
    }
