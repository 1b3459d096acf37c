"""Interactive slices over the filtered fact, the review mart and the daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions.amounts import guarded_ratio, month_bucket
from ledgerspark.functions.rules import severity_score
from ledgerspark.operators.aggregates import ROWS, Measures, mean, total
from ledgerspark.operators.joins import scalar_cross_join, visible_semi_join
from ledgerspark.operators.ordering import display_position, multi_key_sort, top_k_limit, top_one

AMOUNT = "amount_abs"


def spend_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.filter("is_debit").groupBy(*keys).agg(F.sum(AMOUNT).alias(AMOUNT))


def kpi_row(filtered: DataFrame, by: Measures = ROWS) -> DataFrame:
    """Headline figures of a selection as one row, also for an empty selection."""
    debit = F.col("is_debit")
    base = filtered.agg(
        total(AMOUNT, debit).alias("spend"),
        total(AMOUNT, F.col("is_credit")).alias("credits"),
        by.count(F.col("is_anomaly")).alias("anomaly_count"),
        by.count().alias("transaction_count"),
        by.mean(debit).alias("avg_debit"),
        total(AMOUNT, debit & F.col("is_recurring")).alias("recurring_total"),
    )
    leader = top_one(spend_by(filtered, "final_category"), [(AMOUNT, "desc"), ("final_category", "asc")])
    top = leader.select(F.col("final_category").alias("top_category"), F.col(AMOUNT).alias("top_category_spend"))
    wide = scalar_cross_join(base, top)
    return wide.withColumns(
        {
            "top_category": F.coalesce("top_category", F.lit("—")),
            "top_category_spend": F.coalesce("top_category_spend", F.lit(0).cast("decimal(18,2)")),
        }
    )


def spend_by_month_category(filtered: DataFrame) -> DataFrame:
    monthly = filtered.withColumn("month", month_bucket(F.col("transaction_date")))
    return spend_by(monthly, "month", "final_category")


def spend_by_category(filtered: DataFrame) -> DataFrame:
    return multi_key_sort(spend_by(filtered, "final_category"), [(AMOUNT, "desc"), ("final_category", "asc")])


def top_merchants(filtered: DataFrame, k: int = 15) -> DataFrame:
    order = [(AMOUNT, "desc"), ("normalized_merchant", "asc")]
    return top_k_limit(spend_by(filtered, "normalized_merchant"), order, k)


def daily_spend(filtered: DataFrame) -> DataFrame:
    return spend_by(filtered, "transaction_date")


def anomaly_ranking(filtered: DataFrame, k: int = 10) -> DataFrame:
    severity = severity_score(F.col("zscore_vs_merchant"), F.col("zscore_vs_category"))
    flagged = filtered.filter("is_anomaly").select(
        "transaction_id",
        "transaction_date",
        "normalized_merchant",
        "final_category",
        AMOUNT,
        "anomaly_reason",
        "zscore_vs_merchant",
        "zscore_vs_category",
        severity.alias("severity"),
    )
    order = [("zscore_vs_merchant", "desc"), ("zscore_vs_category", "desc"), ("transaction_id", "asc")]
    return top_k_limit(flagged, order, k)


def recurring_visible(recurring_mart: DataFrame, filtered: DataFrame) -> DataFrame:
    visible = visible_semi_join(recurring_mart, filtered.filter("is_debit and is_recurring"), "normalized_merchant")
    return multi_key_sort(visible, [("estimated_monthly_cost", "desc"), ("normalized_merchant", "asc")])


def review_summary(review: DataFrame, filtered: DataFrame) -> DataFrame:
    visible = visible_semi_join(review, filtered, "raw_description")
    open_item = F.col("needs_review")
    return visible.agg(
        F.count_if(open_item).alias("needs_review_count"),
        total("total_spend", open_item).alias("unmapped_spend"),
        F.count_if(~open_item).alias("mapped_count"),
        F.max("review_priority_score").alias("top_priority_score"),
    )


def review_sections(review: DataFrame) -> DataFrame:
    """Review rows by section, with the section's size on each row; a row may be in more than one section."""
    source = F.col("merchant_source")
    sections = F.array_compact(
        F.array(
            F.when(F.col("needs_review"), F.lit("needs_review")),
            F.when(source == K.SOURCE_ENRICHED, F.lit("enriched")),
            F.when(source == K.SOURCE_RULE, F.lit("rule_mapped")),
        )
    )
    sectioned = review.withColumn("section", F.explode(sections))
    # Three sections at most: their sizes travel as one value, so no row moves for them.
    sizes = sectioned.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    listed = sizes.agg(F.map_from_entries(F.collect_list(F.struct("section", "n"))).alias("sizes")).scalar()
    return sectioned.select("section", *review.columns, F.element_at(listed, F.col("section")).alias("section_count"))


METRIC = ["metric_key", "metric_name", "metric_group", "unit"]


def metric_rollup(daily: DataFrame) -> DataFrame:
    """Metric totals on the latest day of a selection, against the 30 days before, in display order."""
    latest = daily.agg(F.max("metric_date").alias("latest")).scalar()
    summed = (
        daily.filter(F.col("metric_date") == latest)
        .groupBy(*METRIC)
        .agg(
            total("metric_value_l30d").alias("metric_value_l30d"),
            total("metric_value_prior_l30d").alias("metric_value_prior_l30d"),
        )
    )
    delta = F.col("metric_value_l30d") - F.col("metric_value_prior_l30d")
    return summed.withColumns(
        {
            "delta_value": delta,
            "delta_pct": guarded_ratio(delta, F.col("metric_value_prior_l30d")),
            "sort_order": display_position(F.col("metric_key")),
        }
    ).orderBy("sort_order", "metric_group", "metric_name")


def metric_trend(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy("metric_date", *METRIC)
        .agg(total("metric_value_l30d").alias("metric_value_l30d"))
        .orderBy("metric_date", "metric_key")
    )


def selected_window_summary(filtered: DataFrame) -> DataFrame:
    """Totals of a selection with their shares of debit spend, as one row."""
    debit, source = F.col("is_debit"), F.col("merchant_source")
    summed = filtered.agg(
        total(AMOUNT, debit).alias("selected_total_spend"),
        total(AMOUNT, F.col("is_credit")).alias("selected_credit_amount"),
        F.count(F.lit(1)).alias("selected_transaction_count"),
        F.count_if(debit).alias("selected_debit_count"),
        F.count_if("is_credit").alias("selected_credit_count"),
        mean(F.when(debit, F.col(AMOUNT))).alias("selected_avg_debit"),
        total(AMOUNT, debit & F.col("is_recurring")).alias("selected_recurring_spend"),
        total(AMOUNT, debit & F.col("is_anomaly")).alias("selected_anomaly_spend"),
        F.count_if(debit & F.col("is_anomaly")).alias("selected_anomaly_count"),
        total(AMOUNT, debit & (source == K.SOURCE_FALLBACK)).alias("selected_fallback_spend"),
        total(AMOUNT, debit & (source == K.SOURCE_ENRICHED)).alias("selected_cohere_spend"),
        total(AMOUNT, debit & (source == K.SOURCE_RULE)).alias("selected_seed_rule_spend"),
    )
    kinds = ("recurring", "anomaly", "fallback", "cohere", "seed_rule")
    shares = {
        f"selected_{kind}_share": guarded_ratio(F.col(f"selected_{kind}_spend"), F.col("selected_total_spend"))
        for kind in kinds
    }
    return summed.withColumns(shares)


# --- change analysis ---------------------------------------------------------------------------------------------


def window_starts(anchor: Column) -> dict[str, Column]:
    """First and last days of the 30 days up to an anchor and of the 30 days before them."""
    days = K.PERIOD_DAYS
    return {
        "current_window_start": F.date_sub(anchor, days - 1),
        "current_window_end": anchor,
        "prior_window_start": F.date_sub(anchor, 2 * days - 1),
        "prior_window_end": F.date_sub(anchor, days),
    }


def _in_windows(anchor: Column) -> tuple[Column, Column]:
    day, edges = F.col("transaction_date"), window_starts(anchor)
    current = day.between(edges["current_window_start"], edges["current_window_end"])
    prior = day.between(edges["prior_window_start"], edges["prior_window_end"])
    return current, prior


def anchor_date(filtered: DataFrame, daily: DataFrame | None = None) -> Column:
    """Last day of the metric series, or of the selected debits where there is no series.

    One value is fetched here, so that the windows it opens reach every scan as constants.
    """
    day = daily.agg(F.max("metric_date")).head()[0] if daily is not None else None
    if day is None:
        day = filtered.filter("is_debit").agg(F.max("transaction_date")).head()[0]
    return F.lit(day).cast("date")


def rolling_windows(filtered: DataFrame, anchor: Column) -> DataFrame:
    """Spend in the 30 days up to an anchor and in the 30 days before, as one row."""
    current, prior = _in_windows(anchor)
    summed = filtered.filter("is_debit").agg(
        total(AMOUNT, current).alias("current_window_spend"),
        total(AMOUNT, prior).alias("prior_window_spend"),
        total(AMOUNT, current & F.col("is_recurring")).alias("current_window_recurring_spend"),
        total(AMOUNT, current & F.col("is_anomaly")).alias("current_window_anomaly_spend"),
        total(AMOUNT, current & (F.col("merchant_source") == K.SOURCE_FALLBACK)).alias(
            "current_window_fallback_spend"
        ),
    )
    return summed.withColumns(window_starts(anchor))


def change_table(df: DataFrame, dimension: str, anchor: Column) -> DataFrame:
    """Current against prior window per value of a dimension, from one conditional pass; a missing value of the
    dimension is its own line."""
    current, prior = _in_windows(anchor)
    summed = (
        df.filter(current | prior)
        .groupBy(F.coalesce(F.col(dimension), F.lit("Unknown")).alias(dimension))
        .agg(total(AMOUNT, current).alias("current_spend"), total(AMOUNT, prior).alias("prior_spend"))
    )
    delta = F.col("current_spend") - F.col("prior_spend")
    changes = summed.withColumns(
        {"delta_amount": delta, "delta_pct": guarded_ratio(delta, F.col("prior_spend"))}
    )
    return multi_key_sort(changes, [("delta_amount", "desc"), ("current_spend", "desc"), (dimension, "asc")])


def top_mover(changes: DataFrame, dimension: str) -> DataFrame:
    """The largest change in either direction."""
    moved = changes.filter("delta_amount <> 0").withColumn("abs_delta_amount", F.abs("delta_amount"))
    order = [("abs_delta_amount", "desc"), ("current_spend", "desc"), (dimension, "asc")]
    return top_one(moved, order).drop("abs_delta_amount")


def directional_mover(changes: DataFrame, dimension: str, direction: str) -> DataFrame:
    """The largest increase (``up``) or decrease (``down``); no row where nothing moved that way."""
    moved = changes.filter("delta_amount > 0" if direction == "up" else "delta_amount < 0")
    way = "desc" if direction == "up" else "asc"
    return top_one(moved, [("delta_amount", way), ("current_spend", "desc"), (dimension, "asc")])


def primary_mover(changes: DataFrame, dimension: str) -> DataFrame:
    """The largest increase, or the largest change where nothing increased."""
    increase = F.col("delta_amount") > 0
    moved = changes.filter("delta_amount <> 0").withColumns(
        {"__rank": F.when(increase, 0).otherwise(1), "__size": F.abs("delta_amount")}
    )
    order = [("__rank", "asc"), ("__size", "desc"), ("current_spend", "desc"), (dimension, "asc")]
    return top_one(moved, order).drop("__rank", "__size")


def largest_anomalies(filtered: DataFrame, k: int = 5) -> DataFrame:
    flagged = filtered.filter("is_debit and is_anomaly").select(
        "transaction_id", "transaction_date", "normalized_merchant", AMOUNT, "anomaly_reason"
    )
    return top_k_limit(flagged, [(AMOUNT, "desc"), ("transaction_id", "asc")], k)


def largest_anomaly(filtered: DataFrame) -> DataFrame:
    return largest_anomalies(filtered, 1)


def top_categories(filtered: DataFrame, k: int = 5) -> DataFrame:
    whole = filtered.filter("is_debit").agg(F.sum(AMOUNT).alias("whole")).scalar()
    leaders = top_k_limit(spend_by(filtered, "final_category"), [(AMOUNT, "desc"), ("final_category", "asc")], k)
    return leaders.withColumn("spend_share", guarded_ratio(F.col(AMOUNT), whole))


def recurring_merchants(filtered: DataFrame, k: int = 5, by: Measures = ROWS) -> DataFrame:
    keys = ["normalized_merchant", "final_category"]
    grouped = (
        filtered.filter("is_debit and is_recurring")
        .groupBy(*keys)
        .agg(F.sum(AMOUNT).alias(AMOUNT), by.count().alias("transaction_count"))
    )
    order = [(AMOUNT, "desc"), ("transaction_count", "desc"), (keys[0], "asc"), (keys[1], "asc")]
    return top_k_limit(grouped, order, k)
