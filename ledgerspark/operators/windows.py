"""Window operators. Ordered windows run on frames that were aggregated to a bounded size per partition first,
so that one hot key never becomes one oversized task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark.operators.aggregates import deviation, mean
from ledgerspark.operators.joins import null_safe_left_join
from ledgerspark.session import stored


def group_stats(df: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    return df.groupBy(key).agg(
        mean(value).alias(f"{prefix}_avg_amount"), deviation(value).alias(f"{prefix}_std_amount")
    )


def partition_stats_window(df: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """Mean and deviation of the row's group on every row.

    An aggregate joined back equals the unordered window, but combines map-side and leaves the join strategy
    (broadcast, or a skew-split shuffle) to run-time sizes.
    """
    return null_safe_left_join(df, group_stats(df, key, value, prefix), [key])


def previous_dates(df: DataFrame, key: str, day: str, tie: str) -> DataFrame:
    """Per key and day: the first row of that day and the key's previous day.

    The ordered window sees one row per key and day, however many rows share them.
    """
    days = df.groupBy(key, day).agg(F.min(tie).alias("__first"))
    previous = F.lag(day).over(Window.partitionBy(key).orderBy(day))
    return days.withColumn("__previous_day", previous)


def lag_from_previous(first: Column, previous_day: Column, day: Column, tie: Column) -> Column:
    """Previous date of a row: an earlier day for the first row of a day, the same day for all others."""
    return F.when(tie == first, previous_day).otherwise(day)


def lag_date_window(df: DataFrame, key: str, day: str, tie: str, name: str) -> DataFrame:
    """Date of the key's previous row in (day, tie) order."""
    days = previous_dates(df, key, day, tie)
    value = lag_from_previous(F.col("__first"), F.col("__previous_day"), F.col(day), F.col(tie))
    joined = null_safe_left_join(df, days, [key, day])
    return joined.withColumn(name, value).drop("__first", "__previous_day")


def rank_over_aggregate(
    df: DataFrame, partition: str, key: str, value: str, sum_name: str, rank_name: str, n: int
) -> DataFrame:
    """The ``n`` largest keys of each partition by summed value, ties by key.

    The rank limit lets Spark drop all but ``n`` rows per task and partition before the window's shuffle.
    """
    sums = df.groupBy(partition, key).agg(F.sum(value).alias(sum_name))
    order = Window.partitionBy(partition).orderBy(F.desc(sum_name), F.asc_nulls_last(key))
    return sums.withColumn(rank_name, F.row_number().over(order)).filter(F.col(rank_name) <= n)


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread_by: str, name: str, parts: int = 64
) -> DataFrame:
    """The first ``k`` rows of each group in an order, numbered from 1.

    A group is first ranked in ``parts`` slices by a hash of ``spread_by`` and then among the leaders of its
    slices, so that a group of any size never meets in one task. Each task also keeps only ``k`` rows per slice
    before it shuffles them.
    """
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(spread_by), F.lit(parts)))
    in_slice = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order))
    leaders = sliced.withColumn("__place", in_slice).filter(F.col("__place") <= k).drop("__place", "__slice")
    in_group = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return leaders.withColumn(name, in_group).filter(F.col(name) <= k)


def top_per_partition(df: DataFrame, partition: str, key: str, value: str, key_name: str, sum_name: str) -> DataFrame:
    """The largest key of each partition by summed value."""
    ranked = rank_over_aggregate(df, partition, key, value, "__sum", "__rank", 1)
    return ranked.select(partition, F.col(key).alias(key_name), F.col("__sum").alias(sum_name))


def number_rows(df: DataFrame, name: str, scratch_name: str) -> DataFrame:
    """Consecutive numbers from 1 in the frame's own row order, without collecting rows in one task.

    Rows are written once with task-local positions; the numbers follow from the row counts of the tasks
    before, one small row per task. Reading both from the written table keeps them consistent on any retry.
    """
    tagged = stored(df.withColumn("__position", F.monotonically_increasing_id()), scratch_name)
    task = F.shiftright("__position", 33)
    counts = tagged.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__task", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    local = F.col("__position").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("__task", task)
        .join(offsets, on="__task", how="left")
        .withColumn(name, F.col("__offset") + local + 1)
        .drop("__task", "__offset", "__position")
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Position of every row in a total order: a range-partitioned sort plus per-task offsets."""
    return number_rows(df.orderBy(*order), name, "ranked")


def lag_ordered_global(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Previous row's value in a frame of one row per period, small by construction."""
    return df.withColumn(name, F.lag(value).over(Window.orderBy(order)))


def lag_partitioned(df: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """Change against the previous observed period of the same partition, as amount and ratio."""
    previous = F.lag(value).over(Window.partitionBy(partition).orderBy(order))
    base = F.nullif(previous.cast("double"), F.lit(0.0))
    return df.withColumns(
        {
            "mom_change_amount": F.col(value) - previous,
            "mom_change_pct": F.col(value).cast("double") / base - 1,
        }
    )


def rolling_sum_30(dense: DataFrame, dims: Sequence[str], day: str, value: str, name: str) -> DataFrame:
    """Sum of the current and the 29 rows before in a series with one row per day."""
    frame = Window.partitionBy(*dims).orderBy(day).rowsBetween(-29, Window.currentRow)
    return dense.withColumn(name, F.sum(value).over(frame))


def lag_offset_30(rolling: DataFrame, dims: Sequence[str], day: str, value: str, name: str) -> DataFrame:
    """Value 30 rows earlier in a series with one row per day; NULL before that."""
    return rolling.withColumn(name, F.lag(value, 30).over(Window.partitionBy(*dims).orderBy(day)))
