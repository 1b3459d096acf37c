"""The whole refresh: raw rows to stored fact and marts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerspark.constants import DECLARED_TESTS
from ledgerspark.operators.quality import require_declared
from ledgerspark.plans.daily import expand_runs, mart_daily_metric_runs, mart_daily_metric_values
from ledgerspark.plans.features import (
    category_stats,
    fact_transactions,
    recurring_keys,
    recurring_transactions,
    transaction_features,
)
from ledgerspark.plans.marts import (
    mart_anomalies,
    mart_category_metrics,
    mart_data_quality,
    mart_merchant_review,
    mart_metric_summary,
    mart_monthly_kpis,
    mart_monthly_spend,
    mart_recurring_spend,
    mart_spend_kpis,
)
from ledgerspark.plans.normalization import known_descriptions, normalize_merchants
from ledgerspark.plans.staging import stage_descriptions, stage_enrichments, stage_transactions
from ledgerspark.session import stored
from ledgerspark.sources.warehouse import Warehouse


DAILY_RUNS = "mart_daily_metric_runs"


@dataclass
class Layers:
    """The frames between raw rows and fact. ``normalized``, ``features`` and ``fact`` are stored."""

    staged: DataFrame
    enrichments: DataFrame
    normalized: DataFrame
    features: DataFrame
    recurring: DataFrame
    fact: DataFrame


def build_layers(
    raw: DataFrame, rules: DataFrame, enrichment_cache: DataFrame, warehouse: Warehouse | None = None
) -> Layers:
    """Staging stays lazy. Layers that several later jobs read are written once, so that rules are matched and
    statistics joined a single time however many marts follow. With a warehouse the fact goes straight to its
    table there, and its files are ordered by date, so that date filters skip row groups."""
    staged = stage_transactions(raw)
    enrichments = stage_enrichments(enrichment_cache)
    descriptions = stored(stage_descriptions(raw), "descriptions")
    known = stored(known_descriptions(descriptions, rules, enrichments), "known-descriptions")
    normalized = stored(normalize_merchants(staged, rules, enrichments, known), "normalized")
    categories = stored(category_stats(normalized), "categories")
    features = stored(transaction_features(normalized, categories), "features")
    recurring = stored(recurring_transactions(features), "recurring")
    steady = stored(recurring_keys(recurring), "recurring-keys")
    fact = fact_transactions(features, steady).sortWithinPartitions("transaction_date")
    fact = warehouse.full_refresh_write(fact, "fct_transactions") if warehouse else stored(fact, "fact")
    return Layers(staged, enrichments, normalized, features, recurring, fact)


def build_marts(
    layers: Layers, start: str | None = None, end: str | None = None, daily_tasks: int | None = None
) -> dict[str, DataFrame]:
    """Lazy marts over the stored fact. ``start`` and ``end`` bound the days of the daily mart, and ``daily_tasks``
    sets the number of tasks that write it."""
    recurring_mart = mart_recurring_spend(layers.recurring)
    fact = layers.fact
    return {
        "fct_transactions": fact,
        "mart_anomalies": mart_anomalies(fact),
        "mart_recurring_spend": recurring_mart,
        "mart_monthly_spend": mart_monthly_spend(fact),
        "mart_monthly_kpis": mart_monthly_kpis(fact),
        "mart_category_metrics": mart_category_metrics(fact),
        "mart_spend_kpis": mart_spend_kpis(fact, recurring_mart),
        "mart_data_quality": mart_data_quality(fact),
        "mart_merchant_review": mart_merchant_review(fact),
        "mart_metric_summary": mart_metric_summary(fact),
        "mart_daily_metric_values": mart_daily_metric_values(fact, start=start, end=end, partitions=daily_tasks),
    }


def run_pipeline(
    raw: DataFrame,
    rules: DataFrame,
    enrichment_cache: DataFrame,
    warehouse: Warehouse,
    start: str | None = None,
    end: str | None = None,
    daily_tasks: int | None = None,
) -> dict[str, DataFrame]:
    """Refresh every mart of a warehouse from raw rows and run the declared tests; returns the marts.

    The daily mart is stored as runs of days (``mart_daily_metric_runs``) and expanded when it is read; ``start`` and ``end``
    bound the days that come out of the returned frame.
    """
    layers = build_layers(raw, rules, enrichment_cache, warehouse)
    marts = build_marts(layers)
    fact = marts.pop("fct_transactions")
    del marts["mart_daily_metric_values"]
    marts[DAILY_RUNS] = mart_daily_metric_runs(layers.fact, daily_tasks)
    written = {"fct_transactions": fact} | {name: warehouse.full_refresh_write(frame, name) for name, frame in marts.items()}
    # A day has the columns of its run, so a missing value in a run is one in the days.
    days = written[DAILY_RUNS].withColumnRenamed("first_day", "metric_date")
    require_declared(tested_tables(layers, written | {"mart_daily_metric_values": days}), DECLARED_TESTS)
    return written | {"mart_daily_metric_values": stored_daily_mart(warehouse, start, end)}


def stored_daily_mart(warehouse: Warehouse, start: str | None = None, end: str | None = None) -> DataFrame:
    """The days from ``start`` to ``end`` of the daily mart of a warehouse."""
    return expand_runs(warehouse.table(DAILY_RUNS), start=start, end=end)


def tested_tables(layers: Layers, marts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that tests are declared for, by name."""
    return marts | {"staged_transactions": layers.staged, "staged_enrichments": layers.enrichments}
