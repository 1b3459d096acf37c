"""The dense daily mart by day and metric: whole cents add up to what decimals do, and dense rows carry no decimal."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerspark.plans import daily
from ledgerspark.registry import marts
from tests.frames import small_fact
from tests.test_plan_shapes import plan

SERIES = ["metric_date", "metric_key", "metric_name", "metric_group", "unit"]


def by_decimals(mart):
    sums = [F.sum(name).alias(name) for name in marts.DAILY_SUMS]
    return mart.groupBy(*SERIES).agg(F.count("*").alias("series_count"), *sums, F.sum("fingerprint").alias("fingerprint"))


def agree(mart):
    mine, plain = marts.by_day_and_metric(mart), by_decimals(mart)
    assert sorted(mine.schema.names) == sorted(plain.schema.names)
    assert [mine.schema[name].dataType for name in plain.columns] == [plain.schema[name].dataType for name in plain.columns]
    rows = sorted(mine.select(*plain.columns).collect(), key=str)
    assert rows == sorted(plain.collect(), key=str) and rows
    return rows


def test_days_of_a_fact(spark):
    rows = agree(daily.mart_daily_metric_values(small_fact(spark), derived=marts.day_entries()))
    assert any(row.metric_value_prior_l30d is None for row in rows)


def test_large_values_and_missing_ones(spark):
    """Values on both sides of the bound, some beyond what whole cents could hold together."""
    high, edge = Decimal("99999999999999999999999999.99"), Decimal(marts.CENTS_BELOW)
    values = [(high, edge, None), (-high, -edge, None), (Decimal("0.01"), edge - Decimal("0.01"), None), (high, Decimal("-3.10"), edge), (None, None, None)]
    made = [("2025-01-01" if n < 3 else "2025-01-02", "spend", "Spend", "Sums", "currency", "a", "b", "c", "d", *v) for n, v in enumerate(values)]
    dims = ", ".join(f"{name} string" for name in [*SERIES, *daily.DIMS])
    frame = spark.createDataFrame(made, dims + "".join(f", {name} decimal(28,2)" for name in marts.DAILY_SUMS))
    rows = agree(frame.withColumns(marts.day_entries()))
    assert rows[0].metric_value == Decimal("0.01") and rows[0].metric_value_prior_l30d is None
    assert rows[1].metric_value == high and rows[1].metric_value_prior_l30d == edge


def test_dense_rows_meet_by_day_and_one_text(spark):
    text = plan(marts.by_day_and_metric(daily.mart_daily_metric_values(small_fact(spark), derived=marts.day_entries())))
    dense = [line for line in text.splitlines() if "partial_count(1)" in line]
    assert len(dense) == 1 and dense[0].count("string") == 0
    keys = dense[0][dense[0].index("keys=[") : dense[0].index("]")]
    assert keys.count(",") == 1 and "metric_date" in keys and "line" in keys
