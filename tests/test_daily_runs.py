from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerspark.plans import daily
from ledgerspark.plans.pipeline import DAILY_RUNS, run_pipeline, stored_daily_mart
from ledgerspark.schemas import ENRICHMENT_CACHE
from ledgerspark.session import stored
from ledgerspark.sources.warehouse import Warehouse
from tests.frames import raw, small_fact
from tests.test_layers import as_mapping, brute_daily, rules


@pytest.mark.parametrize("start, end", [(None, None), ("2025-02-10", "2025-02-12"), ("2025-03-05", None), (None, "2025-01-01"), ("2030-01-01", None)])
def test_expanded_days_are_those_of_the_mart(spark, start, end):
    fact = small_fact(spark)
    runs = stored(daily.mart_daily_metric_runs(fact), "runs")
    whole = brute_daily(fact.collect(), 0, 79)
    kept = {key: value for key, value in whole.items() if (not start or str(key[-1]) >= start) and (not end or str(key[-1]) <= end)}
    assert as_mapping(daily.expand_runs(runs, start=start, end=end)) == kept


def test_runs_cover_each_day_once_and_stay_few(spark):
    fact = small_fact(spark)
    runs = daily.mart_daily_metric_runs(fact)
    series = [*daily.DIMS, "metric_key"]
    days = runs.groupBy(*series).agg(F.sum(F.datediff("last_day", "first_day") + 1).alias("days"), F.count("*").alias("runs"))
    events = daily.daily_values(fact).groupBy(*series).agg(F.count("*").alias("events"))
    for row in days.join(events, series).collect():
        assert row.days == 80 and row.runs <= 3 * row.events + 1


def test_asked_days_reach_the_scan(spark):
    runs = stored(daily.mart_daily_metric_runs(small_fact(spark)), "runs")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = daily.expand_runs(runs, start="2025-02-10", end="2025-02-12")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(last_day,2025-02-10)" in plan and "LessThanOrEqual(first_day,2025-02-12)" in plan
    assert "Exchange" not in plan


def test_a_refresh_stores_runs_only(spark, tmp_path):
    rows = [(f"0{m}/{d:02d}/2025", "MARKET" if d % 2 else "BAR", "Food", str(-10 * d)) for m in (1, 2, 3) for d in range(1, 28)]
    house = Warehouse(spark, str(tmp_path))
    marts = run_pipeline(raw(spark, rows), rules(spark), spark.createDataFrame([], ENRICHMENT_CACHE), house)
    assert not os.path.exists(house.path("mart_daily_metric_values")) and os.path.exists(house.path(DAILY_RUNS))
    dense = daily.mart_daily_metric_values(marts["fct_transactions"])
    assert as_mapping(marts["mart_daily_metric_values"]) == as_mapping(dense) == as_mapping(stored_daily_mart(house))
    march = as_mapping(stored_daily_mart(house, "2025-03-01", "2025-03-02"))
    assert march == {key: value for key, value in as_mapping(dense).items() if str(key[-1]) in ("2025-03-01", "2025-03-02")}
    assert marts[DAILY_RUNS].count() < dense.count()  # something happens every other day here


def test_derived_columns_are_worked_out_once_for_equal_days(spark):
    """They equal those of the dense rows and are computed below the step that makes the days."""
    mark = F.md5(F.concat_ws("|", "normalized_merchant", F.col("metric_value").cast("string"), F.col("metric_value_l30d").cast("string"),
                             F.coalesce(F.col("metric_value_prior_l30d").cast("string"), F.lit("none"))))
    dense = daily.mart_daily_metric_values(small_fact(spark), derived={"mark": mark})
    assert dense.count() > 500 and dense.where(F.col("mark") != mark).count() == 0
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence") < plan.index("md5(")
