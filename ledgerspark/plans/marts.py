"""Metric marts over the fact. Those with a ``by`` also read rows that stand for many transactions (``Measures``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions import rules
from ledgerspark.functions.amounts import delta_columns, guarded_change_pct, guarded_ratio, month_bucket, rounded
from ledgerspark.operators.aggregates import (
    ROWS,
    Measures,
    deviation,
    exact_median,
    latest_vs_prior_month,
    mean,
    top_n_sum,
    total,
    two_level_aggregate,
)
from ledgerspark.operators.calendar import period_bounds, period_bucket
from ledgerspark.operators.joins import scalar_cross_join
from ledgerspark.operators.ordering import multi_key_sort, top_one
from ledgerspark.operators.windows import (
    lag_ordered_global,
    lag_partitioned,
    rank_over_aggregate,
    top_per_partition,
)


def debits_by_month(fact: DataFrame) -> DataFrame:
    return fact.filter("is_debit").withColumn("month", month_bucket(F.col("transaction_date")))


def mart_anomalies(fact: DataFrame) -> DataFrame:
    severity = rules.severity_score(F.col("zscore_vs_merchant"), F.col("zscore_vs_category"))
    return fact.filter("is_anomaly").select(
        "transaction_id",
        "transaction_date",
        "normalized_merchant",
        "final_category",
        "amount_abs",
        "anomaly_reason",
        severity.alias("severity_score"),
    )


def mart_recurring_spend(recurring: DataFrame) -> DataFrame:
    cost = rules.monthly_cost_estimate(F.col("cadence"), F.col("avg_amount"))
    return recurring.filter("is_recurring").select(
        "normalized_merchant",
        "final_category",
        "cadence",
        "avg_amount",
        "amount_stddev",
        "transaction_count",
        "first_seen",
        "last_seen",
        cost.alias("estimated_monthly_cost"),
    )


def mart_monthly_spend(fact: DataFrame, by: Measures = ROWS) -> DataFrame:
    monthly = (
        debits_by_month(fact)
        .groupBy("month", "final_category")
        .agg(
            F.sum("amount_abs").alias("total_spend"),
            by.count().alias("transaction_count"),
            by.mean().alias("avg_transaction_amount"),
        )
    )
    return lag_partitioned(monthly, "final_category", "month", "total_spend")


def mart_monthly_kpis(fact: DataFrame, by: Measures = ROWS) -> DataFrame:
    debits = debits_by_month(fact)
    months = debits.groupBy("month").agg(
        F.sum("amount_abs").alias("total_spend"),
        by.count().alias("transaction_count"),
        by.mean().alias("avg_transaction_amount"),
        total("amount_abs", F.col("is_recurring")).alias("recurring_spend"),
        by.count(F.col("is_anomaly")).alias("anomaly_count"),
        total("amount_abs", F.col("is_anomaly")).alias("anomaly_spend"),
    )
    leaders = [
        by.median(debits, ["month"], "median_transaction_amount"),
        top_per_partition(debits, "month", "final_category", "amount_abs", "top_category", "top_category_spend"),
        top_per_partition(debits, "month", "normalized_merchant", "amount_abs", "top_merchant", "top_merchant_spend"),
    ]
    wide = lag_ordered_global(months, "month", "total_spend", "previous")
    for leader in leaders:
        wide = wide.join(leader, on="month", how="left")
    spend, previous = F.col("total_spend"), F.col("previous")
    return wide.select(
        "month",
        "total_spend",
        "transaction_count",
        "avg_transaction_amount",
        "median_transaction_amount",
        "top_category",
        "top_category_spend",
        "top_merchant",
        "top_merchant_spend",
        "recurring_spend",
        guarded_ratio(F.col("recurring_spend"), spend).alias("recurring_spend_share"),
        "anomaly_count",
        "anomaly_spend",
        (spend - previous).alias("mom_spend_change_amount"),
        guarded_change_pct(spend, previous).alias("mom_spend_change_pct"),
    )


def mart_category_metrics(fact: DataFrame, by: Measures = ROWS) -> DataFrame:
    debits = debits_by_month(fact)
    key = "final_category"
    base = debits.groupBy(key).agg(
        F.sum("amount_abs").alias("total_spend"),
        by.count().alias("transaction_count"),
        by.mean().alias("avg_transaction_amount"),
        by.largest().alias("largest_transaction_amount"),
    )
    monthly = two_level_aggregate(debits, [key, "month"], [key], "amount_abs")
    leader = top_per_partition(
        debits, key, "normalized_merchant", "amount_abs", "top_merchant", "top_merchant_spend"
    )
    movement = latest_vs_prior_month(debits, key, "month", "amount_abs")
    overall = base.agg(F.sum("total_spend").alias("overall")).scalar()
    wide = base.join(monthly, key, "left").join(leader, key, "left").join(movement, key, "left")
    latest, prior = F.col("latest_month_spend"), F.col("prior_month_spend")
    spread = F.coalesce("stddev_of_sums", F.lit(0.0))
    return wide.select(
        key,
        "total_spend",
        guarded_ratio(F.col("total_spend"), overall).alias("spend_share"),
        F.col("mean_of_sums").alias("monthly_avg_spend"),
        spread.alias("monthly_spend_stddev"),
        guarded_ratio(spread, F.col("mean_of_sums")).alias("monthly_spend_volatility"),
        "transaction_count",
        "avg_transaction_amount",
        "largest_transaction_amount",
        "top_merchant",
        "top_merchant_spend",
        "latest_month_spend",
        "prior_month_spend",
        (latest - prior).alias("latest_mom_change_amount"),
        guarded_change_pct(latest, prior).alias("latest_mom_change_pct"),
    )


SOURCE_PREFIX = {"fallback": K.SOURCE_FALLBACK, "cohere": K.SOURCE_ENRICHED, "seed_rule": K.SOURCE_RULE}


def mart_spend_kpis(fact: DataFrame, recurring_mart: DataFrame, by: Measures = ROWS) -> DataFrame:
    """One row of global figures; every rate and share is over debits only."""
    debit, amount = F.col("is_debit"), "amount_abs"
    anomaly = debit & F.col("is_anomaly")
    sources = []
    for prefix, source in SOURCE_PREFIX.items():
        from_source = debit & (F.col("merchant_source") == source)
        sources += [
            by.count(from_source).alias(f"{prefix}_transaction_count"),
            total(amount, from_source).alias(f"{prefix}_spend"),
        ]
    base = fact.agg(
        total(amount, debit).alias("total_spend"),
        total(amount, F.col("is_credit")).alias("credit_amount"),
        by.count().alias("transaction_count"),
        by.count(debit).alias("debit_transaction_count"),
        by.mean(debit).alias("avg_transaction_amount"),
        by.count(anomaly).alias("anomaly_count"),
        total(amount, anomaly).alias("anomaly_spend"),
        *sources,
    )
    debits = fact.filter("is_debit")

    def leader(column: str, name: str) -> DataFrame:
        sums = debits.groupBy(F.col(column).alias(name)).agg(F.sum(amount).alias(f"{name}_spend"))
        return top_one(sums, [(f"{name}_spend", "desc"), (name, "asc")])

    recurring = recurring_mart.agg(
        F.coalesce(F.sum("estimated_monthly_cost"), F.lit(0.0)).alias("estimated_monthly_recurring_spend")
    )
    wide = scalar_cross_join(
        base,
        by.median(debits, [], "median_transaction_amount"),
        leader("final_category", "top_category"),
        leader("normalized_merchant", "top_merchant"),
        top_n_sum(debits, "normalized_merchant", amount, 5, "top_5_merchant_spend"),
        recurring,
    )
    zero = F.lit(0).cast("decimal(18,2)")
    wide = wide.withColumns({name: F.coalesce(name, zero) for name in ("top_category_spend", "top_merchant_spend")})
    spend, count = F.col("total_spend"), F.col("debit_transaction_count")

    def share(column: str):
        return guarded_ratio(F.col(column), spend)

    def rate(column: str):
        return guarded_ratio(F.col(column), count)

    by_source = []
    for prefix in SOURCE_PREFIX:
        by_source += [
            f"{prefix}_transaction_count",
            f"{prefix}_spend",
            rate(f"{prefix}_transaction_count").alias(f"{prefix}_transaction_share"),
            share(f"{prefix}_spend").alias(f"{prefix}_spend_share"),
        ]
    return wide.select(
        "total_spend",
        "credit_amount",
        "transaction_count",
        "debit_transaction_count",
        "avg_transaction_amount",
        "median_transaction_amount",
        "top_category",
        "top_category_spend",
        share("top_category_spend").alias("top_category_spend_share"),
        "top_merchant",
        "top_merchant_spend",
        share("top_merchant_spend").alias("top_merchant_spend_share"),
        "top_5_merchant_spend",
        share("top_5_merchant_spend").alias("top_5_merchant_spend_share"),
        "estimated_monthly_recurring_spend",
        share("estimated_monthly_recurring_spend").alias("recurring_spend_share"),
        "anomaly_count",
        "anomaly_spend",
        rate("anomaly_count").alias("anomaly_transaction_rate"),
        share("anomaly_spend").alias("anomaly_spend_share"),
        *by_source,
    )


def mart_data_quality(fact: DataFrame, by: Measures = ROWS) -> DataFrame:
    by_source = (
        fact.filter("is_debit")
        .groupBy("merchant_source", "category_source")
        .agg(
            by.count().alias("transaction_count"),
            F.sum("amount_abs").alias("total_spend"),
            F.count_distinct("raw_description").alias("unique_raw_descriptions"),
            F.count_distinct("normalized_merchant").alias("unique_normalized_merchants"),
        )
    )
    whole = fact.filter("is_debit").agg(
        by.count().alias("__count"), F.sum("amount_abs").alias("__spend")
    )
    wide = scalar_cross_join(by_source, whole)
    return wide.select(
        "merchant_source",
        "category_source",
        "transaction_count",
        "total_spend",
        guarded_ratio(F.col("transaction_count"), F.col("__count")).alias("transaction_share"),
        guarded_ratio(F.col("total_spend"), F.col("__spend")).alias("spend_share"),
        "unique_raw_descriptions",
        "unique_normalized_merchants",
    )


REVIEW_KEYS = [
    "raw_description",
    "normalized_merchant",
    "merchant_group",
    "merchant_source",
    "category_source",
    "raw_category",
    "final_category",
]


def mart_merchant_review(fact: DataFrame, by: Measures = ROWS) -> DataFrame:
    """Review queue: one row per description and resolution, with reason and priority."""
    debit = F.col("is_debit")
    grouped = fact.groupBy(*REVIEW_KEYS).agg(
        by.count().alias("transaction_count"),
        total("amount_abs", debit).alias("total_spend"),
        rounded(by.mean(debit), 2).alias("avg_debit_amount"),
        by.first().alias("first_seen"),
        by.last().alias("last_seen"),
        by.count(F.col("is_anomaly")).alias("anomaly_count"),
        F.bool_or(F.coalesce("is_recurring", F.lit(False))).alias("has_recurring_flag"),
    )
    source, count, spend = F.col("merchant_source"), F.col("transaction_count"), F.col("total_spend")
    merchant, raw = F.col("normalized_merchant"), F.col("raw_description")
    scored = grouped.withColumns(
        {
            "needs_review": rules.needs_review_flag(source, F.col("merchant_group"), merchant, raw),
            "review_reason": rules.review_reason(source, count, spend, merchant, raw),
            "review_priority_score": rules.review_priority(source, count, spend),
        }
    )
    return multi_key_sort(
        scored, [("needs_review", "desc"), ("review_priority_score", "desc"), ("total_spend", "desc")]
    )


def period_base(fact: DataFrame) -> DataFrame:
    """Debit figures of the last two periods, one wide row per period."""
    debits = period_bucket(fact, "transaction_date").filter("is_debit")
    key, amount = "period_name", "amount_abs"

    def of_source(source: str):
        return total(amount, F.col("merchant_source") == source)

    base = debits.groupBy(key).agg(
        F.sum(amount).alias("total_spend"),
        F.count(F.lit(1)).alias("debit_transaction_count"),
        mean(amount).alias("avg_transaction_amount"),
        guarded_ratio(deviation(amount), mean(amount)).alias("transaction_amount_volatility"),
        total(amount, F.col("is_anomaly")).alias("anomaly_spend"),
        total(amount, F.col("is_recurring")).alias("recurring_spend"),
        of_source(K.SOURCE_FALLBACK).alias("fallback_spend"),
        of_source(K.SOURCE_ENRICHED).alias("cohere_spend"),
        of_source(K.SOURCE_RULE).alias("seed_rule_spend"),
    )
    top_category = top_per_partition(debits, key, "final_category", amount, "top_category", "top_category_spend")
    merchants = rank_over_aggregate(debits, key, "normalized_merchant", amount, "__spend", "__rank", 5)
    top_merchants = merchants.groupBy(key).agg(
        F.max("__spend").alias("top_merchant_spend"), F.sum("__spend").alias("top_5_merchant_spend")
    )
    for part in (exact_median(debits, [key], amount, "median_transaction_amount"), top_category, top_merchants):
        base = base.join(part, on=key, how="left")
    return base


def metric_unpivot(base: DataFrame) -> DataFrame:
    """One row per period and metric from the wide period rows, in a single pass with the metric texts."""
    shares = {
        "top_category_share": "top_category_spend",
        "top_merchant_share": "top_merchant_spend",
        "top_5_merchant_share": "top_5_merchant_spend",
        "recurring_spend_share": "recurring_spend",
        "anomaly_spend_share": "anomaly_spend",
        "fallback_spend_share": "fallback_spend",
        "cohere_spend_share": "cohere_spend",
        "seed_rule_spend_share": "seed_rule_spend",
    }
    entries = []
    for key, label, group, unit, direction, definition in K.PERIOD_METRICS:
        source = shares.get(key)
        value = guarded_ratio(F.col(source), F.col("total_spend")) if source else F.col(key).cast("double")
        entries.append(
            F.struct(
                F.lit(key).alias("metric_key"),
                F.lit(label).alias("metric_label"),
                F.lit(group).alias("metric_group"),
                value.alias("metric_value"),
                F.lit(unit).alias("unit"),
                F.lit(direction).alias("favorable_direction"),
                F.lit(definition).alias("definition"),
            )
        )
    return base.select("period_name", F.inline(F.array(*entries)))


def mart_metric_summary(fact: DataFrame) -> DataFrame:
    """Thirteen metrics of the last 30 days against the 30 days before."""
    texts = ["metric_key", "metric_label", "metric_group", "unit", "favorable_direction", "definition"]
    current = F.col("period_name") == "current"
    paired = (
        metric_unpivot(period_base(fact))
        .groupBy(*texts)
        .agg(
            F.max(F.when(current, F.col("metric_value"))).alias("metric_value"),
            F.max(F.when(~current, F.col("metric_value"))).alias("comparison_value"),
            F.bool_or(current).alias("__current"),
        )
        .filter("__current")
    )
    wide = scalar_cross_join(paired, period_bounds(fact, "transaction_date"))
    deltas = delta_columns(F.col("metric_value"), F.col("comparison_value"))
    return wide.select(
        "as_of_date",
        "current_period_start",
        F.col("as_of_date").alias("current_period_end"),
        "comparison_period_start",
        "comparison_period_end",
        "metric_key",
        "metric_label",
        "metric_group",
        "metric_value",
        "comparison_value",
        *[column.alias(name) for name, column in deltas.items()],
        "unit",
        "favorable_direction",
        "definition",
    )
