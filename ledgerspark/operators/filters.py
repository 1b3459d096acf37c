"""User-facing filters as predicates, so that they reach the scan of a stored fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

VIEW_FLAGS = {
    "debits": "is_debit",
    "credits": "is_credit",
    "anomalies": "is_anomaly",
    "recurring": "is_recurring",
}


def _common(
    df: DataFrame, day: str, start: str | None, end: str | None,
    categories: Sequence[str] | None, merchants: Sequence[str] | None,
) -> DataFrame:
    if start:
        df = df.filter(F.col(day) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(day) <= F.lit(end).cast("date"))
    if categories:
        df = df.filter(F.col("final_category").isin(*categories))
    if merchants:
        df = df.filter(F.col("normalized_merchant").isin(*merchants))
    return df


def filter_transactions(
    df: DataFrame, start: str | None = None, end: str | None = None,
    categories: Sequence[str] | None = None, merchants: Sequence[str] | None = None, view: str = "all",
) -> DataFrame:
    """Inclusive date range, categories, merchants and a view (all, debits, credits, anomalies, recurring)."""
    kept = _common(df, "transaction_date", start, end, categories, merchants)
    return kept.filter(VIEW_FLAGS[view]) if view in VIEW_FLAGS else kept


def filter_daily_metrics(
    df: DataFrame, start: str | None = None, end: str | None = None,
    categories: Sequence[str] | None = None, merchants: Sequence[str] | None = None, view: str = "all",
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """The same filters on the daily metric series, where a view selects metrics by key prefix."""
    kept = _common(df, "metric_date", start, end, categories, merchants)
    key = F.col("metric_key")
    views = {
        "debits": ~key.startswith("credit_"),
        "credits": key.startswith("credit_"),
        "anomalies": key.startswith("anomaly_"),
        "recurring": key.startswith("recurring_"),
    }
    if view in views:
        kept = kept.filter(views[view])
    return kept.filter(F.col("metric_group").isin(*groups)) if groups else kept


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
