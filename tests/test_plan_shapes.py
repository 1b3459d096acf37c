"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators.filters import filter_transactions
from ledgerspark.operators.joins import composite_left_join
from ledgerspark.plans import daily, features, marts, normalization, slices
from ledgerspark.plans.staging import stage_transactions
from ledgerspark.schemas import ENRICHMENT_CACHE
from ledgerspark.session import stored
from tests.frames import raw, small_fact
from tests.test_layers import rules


def plan(frame) -> str:
    spark = frame.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return frame.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fact(spark):
    return stored(small_fact(spark), "plan-fact")


def staged(spark):
    return stage_transactions(raw(spark, [("01/01/2025", "UBER", "Food", "-1.00")]))


def test_rules_are_matched_without_products(spark):
    text = plan(normalization.with_best_rule(staged(spark), rules(spark)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


def test_no_products_and_no_python_in_the_marts(spark, fact):
    recurring = spark.createDataFrame([], "estimated_monthly_cost double")
    frames = [
        marts.mart_monthly_kpis(fact), marts.mart_category_metrics(fact), marts.mart_spend_kpis(fact, recurring),
        marts.mart_data_quality(fact), marts.mart_metric_summary(fact), daily.mart_daily_metric_values(fact),
        slices.kpi_row(fact), slices.metric_rollup(daily.daily_totals(fact)),
    ]
    for frame in frames:
        text = plan(frame)
        for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "BatchEvalPython"):
            assert unwanted not in text


def test_features_move_the_transactions_once(spark):
    normalized = stored(
        normalization.normalize_merchants(staged(spark), rules(spark), spark.createDataFrame([], ENRICHMENT_CACHE)),
        "plan-normalized",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moving = plan(features.transaction_features(normalized))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
        text = plan(features.transaction_features(normalized, stored(features.category_stats(normalized), "plan-categories")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # Whole rows carry the row number of the file; with stored category statistics Catalyst broadcasts these.
    assert "hashpartitioning(coalesce(final_category" in moving
    assert "hashpartitioning(coalesce(final_category" not in text
    # The ordered window sees days, never transactions: its input comes out of an aggregate.
    window = text[text.index("Window"):]
    assert "HashAggregate" in window.split("FileScan")[0]


def test_windows_of_the_daily_mart_see_sparse_rows(fact):
    text = plan(daily.mart_daily_metric_values(fact))
    assert text.index("Generate") < text.index("Window")
    assert "HashAggregate" in text[text.index("Window"):]
    # One move by day and dimensions, one by series; the subqueries for the date bounds bring single rows.
    assert text.count("Exchange hashpartitioning") == 2


def test_filters_and_columns_reach_the_scan(fact):
    chosen = filter_transactions(fact, "2025-01-05", "2025-02-01", ["Food"], None, "debits")
    text = plan(slices.spend_by_category(chosen))
    assert "GreaterThanOrEqual(transaction_date" in text and "EqualTo(final_category" in text
    schema = text[text.index("ReadSchema"):]
    assert "search_text" not in schema and "raw_description" not in schema


def test_merchant_filter_reaches_the_scan_through_the_daily_mart(fact):
    from ledgerspark.operators.filters import filter_daily_metrics

    text = plan(filter_daily_metrics(daily.mart_daily_metric_values(fact), merchants=["Beta"]))
    assert "EqualTo(normalized_merchant,Beta)" in text


def test_top_k_is_limited_before_the_shuffle(fact):
    from ledgerspark.operators.windows import rank_over_aggregate

    ranked = rank_over_aggregate(fact, "final_category", "normalized_merchant", "amount_abs", "s", "r", 2)
    assert "WindowGroupLimit" in plan(ranked)
    assert "TakeOrderedAndProject" in plan(slices.top_merchants(fact, 3))


def test_a_hot_key_is_split_in_the_recurrence_join(spark):
    """A third and more of all rows share one merchant; the join splits them over several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        # With eight partitions a third of the rows is less than five times the median partition.
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        merchant = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("m"), (F.col("id") % 5000).cast("string")))
        left = stored(
            spark.range(0, 90000, 1, 8).select("id", merchant.alias("m"), F.lit("c").alias("c"), F.sha2(F.col("id").cast("string"), 256).alias("pad")),
            "skew-left",
        )
        right = left.groupBy("m", "c").agg(F.count("*").alias("n"))
        joined = composite_left_join(left, right, ["m", "c"])
        rows = joined.groupBy((F.col("n") > 1000).alias("hot")).agg(F.count("*").alias("rows"))
        assert {row["hot"]: row["rows"] for row in rows.collect()} == {True: 30000, False: 60000}
        joined.collect()
        final = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
