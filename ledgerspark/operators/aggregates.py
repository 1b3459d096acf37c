"""Aggregations. All combine map-side, so a hot group never travels as raw rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark.functions.amounts import guarded_ratio, magnitude_bucket


def group_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[column.alias(name) for name, column in aggregates.items()])


def mean(column: str | Column) -> Column:
    """Average of a money column as a double: the exact sum in cents, divided once.

    Unlike an average of doubles it does not depend on the order in which partitions are combined.
    """
    value = F.col(column) if isinstance(column, str) else column
    cents = (F.sum(value) * 100).cast("decimal(38,0)").cast("double")
    return cents / F.nullif(F.count(value) * 100, F.lit(0)).cast("double")


def deviation(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.stddev_samp(value.cast("double"))


def total(column: str | Column, condition: Column | None = None) -> Column:
    """Sum with 0 for no rows, optionally only of the rows that meet a condition."""
    value = F.col(column) if isinstance(column, str) else column
    if condition is not None:
        value = F.when(condition, value)
    return F.coalesce(F.sum(value), F.lit(0).cast("decimal(18,2)"))


def conditional_aggregate(
    df: DataFrame, keys: Sequence[str], value: str, predicates: Mapping[str, Column]
) -> DataFrame:
    """Sum, count and mean of a value for each named predicate, in one pass."""
    columns = []
    for name, predicate in predicates.items():
        columns += [
            total(value, predicate).alias(f"{name}_sum"),
            F.count_if(predicate).alias(f"{name}_count"),
            mean(F.when(predicate, F.col(value))).alias(f"{name}_avg"),
        ]
    return df.groupBy(*keys).agg(*columns)


def distinct_count(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts. Catalyst groups by key and value first, which spreads a hot group."""
    return df.groupBy(*keys).agg(*[F.count_distinct(name).alias(f"distinct_{name}") for name in columns])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group without holding a group in one place.

    Equal values are counted first, the counts are summed over magnitude buckets (a bounded number per group),
    and only the buckets that hold the two middle ranks are ordered value by value.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value)).agg(F.count(F.lit(1)).alias("__rows"))
    return median_of_counts(counted, keys, value, "__rows", name)


def median_of_counts(counts: DataFrame, keys: Sequence[str], value: str, rows: str, name: str = "median") -> DataFrame:
    """``exact_median`` of values that are given with their number of rows, each value of a group once."""
    keys = list(keys)
    counted = counts.select(
        *keys, F.col(value).alias("__value"), F.col(rows).alias("__n"), magnitude_bucket(F.col(value)).alias("__bucket")
    )
    in_order = Window.partitionBy(*keys).orderBy("__bucket")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*keys)
    buckets = (
        counted.groupBy(*keys, "__bucket")
        .agg(F.sum("__n").alias("__in_bucket"))
        .withColumn("__upto", F.sum("__in_bucket").over(running))
        .withColumn("__all", F.sum("__in_bucket").over(everything))
        .select(
            *[F.col(key).alias(f"__hit_{key}") for key in keys],
            F.col("__bucket").alias("__hit_bucket"),
            (F.col("__upto") - F.col("__in_bucket")).alias("__before"),
            "__upto",
            F.expr("(__all + 1) div 2").alias("__low"),
            F.expr("__all div 2 + 1").alias("__high"),
        )
        .filter("(__before < __low and __low <= __upto) or (__before < __high and __high <= __upto)")
    )
    same = F.col("__bucket") == F.col("__hit_bucket")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__hit_{key}"))
    middle = counted.join(buckets, same)
    within = Window.partitionBy(*keys, "__bucket").orderBy("__value")
    ranked = middle.withColumn(
        "__last",
        F.col("__before") + F.sum("__n").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    ).withColumn("__first", F.col("__last") - F.col("__n"))
    picked = ranked.filter("(__first < __low and __low <= __last) or (__first < __high and __high <= __last)")
    low, high = F.min("__value").cast("double"), F.max("__value").cast("double")
    return picked.groupBy(*keys).agg(((low + high) / 2).alias(name))


class Measures:
    """Counts, means and medians of the amounts of plain transactions, which the marts are made of."""

    amount = "amount_abs"

    def count(self, condition: Column | None = None) -> Column:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)

    def mean(self, condition: Column | None = None) -> Column:
        return mean(self.amount if condition is None else F.when(condition, F.col(self.amount)))

    def largest(self) -> Column:
        return F.max(self.amount)

    def first(self) -> Column:
        return F.min("transaction_date")

    def last(self) -> Column:
        return F.max("transaction_date")

    def median(self, df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        return exact_median(df, keys, self.amount, name)


ROWS = Measures()


def sample_stddev(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(deviation(value).alias("stddev"))


def coefficient_of_variation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(guarded_ratio(deviation(value), mean(value)).alias("volatility"))


def two_level_aggregate(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str) -> DataFrame:
    """Mean and deviation, per outer group, of the sums of the inner groups."""
    sums = df.groupBy(*inner).agg(F.sum(value).alias("__sum"))
    return sums.groupBy(*outer).agg(mean("__sum").alias("mean_of_sums"), deviation("__sum").alias("stddev_of_sums"))


def bool_or_aggregate(df: DataFrame, keys: Sequence[str], flag: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias(name))


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def ordered_string_agg(df: DataFrame, keys: Sequence[str], value: str, separator: str, name: str) -> DataFrame:
    """Distinct values of a group, ordered and joined. Duplicates go before the shuffle to the group; the
    result cell holds every distinct value by definition."""
    distinct = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), separator).alias(name))


def description_samples(df: DataFrame, key: str, value: str, n: int = 6, name: str = "samples") -> DataFrame:
    """First ``n`` distinct values per key, in order. Spark keeps at most ``n`` per task before the shuffle."""
    distinct = df.filter(F.col(value).isNotNull()).select(key, value).distinct()
    position = F.row_number().over(Window.partitionBy(key).orderBy(value))
    first = distinct.withColumn("__position", position).filter(F.col("__position") <= n)
    return first.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def any_value_aggregate(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One value per group. Any would do; the smallest makes reruns agree."""
    return df.groupBy(*keys).agg(*[F.min(name).alias(name) for name in columns])


def null_group_aggregate(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sum per key where rows without a key form their own group."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


def nan_skipping_sum(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums in which missing values count nothing; a group of only missing values sums to 0."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in columns])


def top_n_sum(df: DataFrame, key: str, value: str, n: int, name: str) -> DataFrame:
    """Sum of the ``n`` largest groups as one row; 0 where there is none."""
    largest = (
        df.groupBy(key).agg(F.sum(value).alias("__sum")).orderBy(F.desc("__sum"), F.asc_nulls_last(key)).limit(n)
    )
    return largest.agg(total("__sum").alias(name))


def latest_vs_prior_month(df: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """Sum in the latest month of the data and in the calendar month before it, per key; 0 where absent."""
    monthly = df.groupBy(key, month).agg(F.sum(value).alias("__sum"))
    latest = df.agg(F.max(month).alias("latest")).scalar()
    return monthly.groupBy(key).agg(
        total("__sum", F.col(month) == latest).alias("latest_month_spend"),
        total("__sum", F.col(month) == F.add_months(latest, -1)).alias("prior_month_spend"),
    )
