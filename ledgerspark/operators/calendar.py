"""Periods, date spines and dense series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark.constants import PERIOD_DAYS


def date_bounds(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


def period_bounds(df: DataFrame, day: str, days: int = PERIOD_DAYS) -> DataFrame:
    """Last ``days`` days of the data and the equally long period before, as one row."""
    last = F.max(day)
    return df.agg(
        last.alias("as_of_date"),
        F.date_sub(last, days - 1).alias("current_period_start"),
        F.date_sub(last, days).alias("comparison_period_end"),
        F.date_sub(last, 2 * days - 1).alias("comparison_period_start"),
    )


def period_bucket(df: DataFrame, day: str, days: int = PERIOD_DAYS) -> DataFrame:
    """Rows of the last two periods, labelled ``current`` or ``comparison``. The anchor is a scalar subquery,
    so the range also reaches the scan."""
    anchor = df.agg(F.max(day).alias("anchor")).scalar()
    value = F.col(day)
    label = F.when(value >= F.date_sub(anchor, days - 1), "current").otherwise("comparison")
    return df.filter(value >= F.date_sub(anchor, 2 * days - 1)).withColumn("period_name", label)


def date_spine(df: DataFrame, day: str, name: str = "metric_date") -> DataFrame:
    """One row per day from the first to the last date of the data."""
    bounds = date_bounds(df, day)
    days = F.sequence("min_date", "max_date", F.expr("interval 1 day"))
    return bounds.filter(F.col("min_date").isNotNull()).select(F.explode(days).alias(name))


def fill_days(df: DataFrame, dims: Sequence[str], day: str, last: Column, held: Sequence[str]) -> DataFrame:
    """Repeat each row for the days up to the next row of its series (or ``last``).

    ``held`` columns keep their value on the added days; the marker ``__added`` is 0 on the row's own day. Only
    the sparse rows are shuffled and ordered; the dense rows come out of a narrow step.
    """
    following = F.lead(day).over(Window.partitionBy(*dims).orderBy(day))
    until = F.coalesce(F.date_sub(following, 1), last)
    spans = df.withColumn("__until", until).select(
        *dims, *held, F.posexplode(F.sequence(day, "__until", F.expr("interval 1 day"))).alias("__added", day)
    )
    return spans


def densify(facts: DataFrame, bounds: DataFrame, dims: Sequence[str], day: str, value: str) -> DataFrame:
    """Every series on every day between the bounds, 0 where it has no fact.

    ``facts`` holds one row per series and day. Each series gets an opening row on the first day, and each row
    is then repeated up to the next one, instead of joining a days-by-series product back to the facts.
    """
    first = bounds.select("min_date").scalar()
    last = bounds.select("max_date").scalar()
    zero = F.lit(0).cast(facts.schema[value].dataType)
    opening = facts.select(*dims).distinct().select(*dims, first.alias(day), zero.alias(value))
    sparse = (
        facts.select(*dims, day, value).unionByName(opening).groupBy(*dims, day).agg(F.sum(value).alias(value))
    )
    dense = fill_days(sparse, dims, day, last, [value])
    on_day = F.when(F.col("__added") == 0, F.col(value)).otherwise(zero)
    return dense.select(day, *dims, on_day.alias(value))
