"""Daily metric events and the dense daily metric series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark import constants as K
from ledgerspark.operators.calendar import date_bounds
from ledgerspark.operators.filters import filter_daily_metrics, filter_transactions
from ledgerspark.sources.warehouse import Warehouse

DIMS = ["final_category", "normalized_merchant", "merchant_source", "category_source"]
VALUE = "decimal(28,2)"
SPAN = K.PERIOD_DAYS

# Transactions whose steps one task has to sort, about.
TASK_ROWS = 125_000


def populations() -> dict[str, Column]:
    """Which rows count for each population of daily metrics."""
    debit, source = F.col("is_debit"), F.col("merchant_source")
    return {
        "debit": debit,
        "credit": F.col("is_credit"),
        "anomaly": debit & F.col("is_anomaly"),
        "recurring": debit & F.col("is_recurring"),
        "fallback": debit & (source == K.SOURCE_FALLBACK),
        "enriched": debit & (source == K.SOURCE_ENRICHED),
        "rule": debit & (source == K.SOURCE_RULE),
    }


def daily_metric_events(fact: DataFrame) -> DataFrame:
    """Every contribution of a transaction to a daily metric, from one pass over the fact."""
    member = populations()
    entries = []
    for population, amount_key, amount_name, count_key, count_name, group in K.DAILY_METRICS:
        for key, name, unit, value in (
            (amount_key, amount_name, "currency", F.col("amount_abs").cast("decimal(18,2)")),
            (count_key, count_name, "count", F.lit(1).cast("decimal(18,2)")),
        ):
            entry = F.struct(
                F.lit(key).alias("metric_key"),
                F.lit(name).alias("metric_name"),
                F.lit(group).alias("metric_group"),
                F.lit(unit).alias("unit"),
                value.alias("metric_value"),
            )
            entries.append(F.when(member[population], entry))
    return fact.select(
        F.col("transaction_date").alias("metric_date"), *DIMS, F.inline(F.array_compact(F.array(*entries)))
    )


def daily_values(fact: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Sparse daily metrics: one row per series and day on which something happened.

    The fact is summed to day and dimensions in wide form first and turned into metric rows afterwards, so the
    shuffle carries one combined row instead of up to eight per transaction.
    """
    member = populations()
    amount = F.col("amount_abs").cast("decimal(18,2)")
    wide = fact.groupBy(F.col("transaction_date").alias("metric_date"), *dims).agg(
        *[F.sum(F.when(rows, amount)).alias(f"{name}_sum") for name, rows in member.items()],
        *[F.count_if(rows).alias(f"{name}_count") for name, rows in member.items()],
    )
    entries = []
    for population, amount_key, _, count_key, _, _ in K.DAILY_METRICS:
        seen = F.col(f"{population}_count")
        for key, value in ((amount_key, F.col(f"{population}_sum")), (count_key, seen)):
            entry = F.struct(F.lit(key).alias("metric_key"), value.cast(VALUE).alias("metric_value"))
            entries.append(F.when(seen > 0, entry))
    return wide.select("metric_date", *dims, F.inline(F.array_compact(F.array(*entries))))


def metric_text(field: int) -> Column:
    """Name (1), group (2) or unit (3) of the row's metric key."""
    pairs = []
    for _, amount_key, amount_name, count_key, count_name, group in K.DAILY_METRICS:
        amount_texts, count_texts = (amount_name, group, "currency"), (count_name, group, "count")
        pairs += [F.lit(amount_key), F.lit(amount_texts[field - 1])]
        pairs += [F.lit(count_key), F.lit(count_texts[field - 1])]
    return F.element_at(F.create_map(*pairs), F.col("metric_key"))


def _step(date: Column, value: Column, current: Column, earlier: Column) -> Column:
    return F.struct(
        date.alias("metric_date"),
        value.cast(VALUE).alias("metric_value"),
        current.cast(VALUE).alias("current_step"),
        earlier.cast(VALUE).alias("earlier_step"),
    )


def tasks_for(fact: DataFrame) -> int | None:
    """Tasks for the steps of a fact; none where the session's number of shuffle partitions, which AQE may merge, is enough."""
    needed = -(-fact.count() // TASK_ROWS)
    return needed if needed > int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def daily_runs(fact: DataFrame, bounds: DataFrame, dims: Sequence[str] = DIMS, partitions: int | None = None) -> DataFrame:
    """Daily series as runs of days: ``first_day`` to ``last_day`` with the sums that hold on all of them.

    A value enters the current sum on its day, moves to the earlier sum after 30 days and leaves after 60. Running totals
    over these sparse steps give both sums, and each step holds up to the next one of its series. Only sparse rows are
    shuffled and sorted, and a series has at most three runs per day on which something happened, however many
    transactions and days there are. ``metric_value`` is that of the first day; on the others it is 0. The earlier sum is
    known from ``prior_from`` on. The steps are placed by series once, which serves their sums and both windows.
    ``partitions`` fixes the number of tasks where the runs will be expanded to far more rows; without it their number grows
    with the transactions, so that what a task holds does not.
    """
    partitions = partitions or (tasks_for(fact) if dims else None)
    series = [*dims, "metric_key"]
    first, last = bounds.select("min_date").scalar(), bounds.select("max_date").scalar()
    day, value, zero = F.col("metric_date"), F.col("metric_value"), F.lit(0).cast(VALUE)
    steps = F.array(
        _step(first, zero, zero, zero),
        _step(day, value, value, zero),
        _step(F.date_add(day, SPAN), zero, -value, value),
        _step(F.date_add(day, 2 * SPAN), zero, zero, -value),
    )
    placed = daily_values(fact, dims).select(*series, F.inline(steps)).filter(day <= last)
    placed = placed.repartition(partitions, *series) if partitions else placed.repartition(*series)
    sparse = (
        placed.groupBy(*series, "metric_date")
        .agg(*[F.sum(name).cast(VALUE).alias(name) for name in ("metric_value", "current_step", "earlier_step")])
    )
    ordered = Window.partitionBy(*series).orderBy("metric_date")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return sparse.select(
        *series,
        day.alias("first_day"),
        F.coalesce(F.date_sub(F.lead(day).over(ordered), 1), last).alias("last_day"),
        metric_text(1).alias("metric_name"),
        metric_text(2).alias("metric_group"),
        metric_text(3).alias("unit"),
        "metric_value",
        F.sum("current_step").over(running).cast(VALUE).alias("metric_value_l30d"),
        F.sum("earlier_step").over(running).cast(VALUE).alias("metric_value_prior_l30d"),
        F.date_add(first, SPAN).alias("prior_from"),
    )


def steady_days(runs: DataFrame) -> DataFrame:
    """Runs cut so that all values hold on every day from ``begins`` to ``ends``: the first day, the days before the earlier
    sum is known, and the rest."""
    first, last, known = F.col("first_day"), F.col("last_day"), F.col("prior_from")
    value, prior, zero = F.col("metric_value"), F.col("metric_value_prior_l30d"), F.lit(0).cast(VALUE)

    def piece(begins: Column, ends: Column, value: Column, prior: Column) -> Column:
        names = {"begins": begins, "ends": ends, "metric_value": value, "metric_value_prior_l30d": prior.cast(VALUE)}
        return F.struct(*(column.alias(name) for name, column in names.items()))

    next_day = F.date_add(first, 1)
    pieces = F.array(
        piece(first, first, value, F.when(first >= known, prior)),
        piece(next_day, F.least(last, F.date_sub(known, 1)), zero, F.lit(None)),
        piece(F.greatest(next_day, known), last, zero, prior),
    )
    others = [name for name in runs.columns if name not in ("first_day", "last_day", "prior_from", "metric_value", "metric_value_prior_l30d")]
    return runs.select(*others, F.inline(pieces)).where("begins <= ends")


def expand_runs(
    runs: DataFrame,
    dims: Sequence[str] = DIMS,
    start: str | None = None,
    end: str | None = None,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Dense daily series from runs, in a narrow step, for the days from ``start`` to ``end`` only. Runs outside of them
    are dropped by the scan of a stored table. ``derived`` columns come from a row's values without its day; they are worked
    out once for all days on which the values hold."""
    begins, ends = F.col("begins"), F.col("ends")
    if start:
        asked = F.lit(start).cast("date")
        runs, begins = runs.filter(F.col("last_day") >= asked), F.greatest(begins, asked)
    if end:
        asked = F.lit(end).cast("date")
        runs, ends = runs.filter(F.col("first_day") <= asked), F.least(ends, asked)
    steady = steady_days(runs).withColumns({"begins": begins, "ends": ends}).where("begins <= ends")
    steady = steady.withColumns(dict(derived or {}))
    dense = steady.withColumn("metric_date", F.explode(F.sequence("begins", "ends", F.expr("interval 1 day"))))
    return dense.select(*mart_columns("metric_date", dims), *(derived or {}))


def mart_columns(day: str, dims: Sequence[str] = DIMS) -> list[str]:
    """The columns of the dense series in their order, with ``day`` for the date."""
    sums = ["metric_value", "metric_value_l30d", "metric_value_prior_l30d"]
    return [day, "metric_key", "metric_name", "metric_group", *dims, *sums, "unit"]


def write_daily_mart(runs: DataFrame, warehouse: Warehouse, table: str) -> DataFrame:
    """Write the dense daily mart of stored runs, a row for every series and day; returns the stored table."""
    steady = steady_days(runs).select(*mart_columns("begins"), "ends")
    return warehouse.full_refresh_days(steady, table, "metric_date")


def dense_metrics(
    fact: DataFrame,
    bounds: DataFrame,
    dims: Sequence[str],
    start: str | None = None,
    end: str | None = None,
    partitions: int | None = None,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Dense daily series per metric and ``dims`` over the days of ``bounds``, with both 30-day sums. ``start`` and ``end``
    bound the days that come out; the sums still see all days."""
    return expand_runs(daily_runs(fact, bounds, dims, partitions), dims, start, end, derived)


def mart_daily_metric_runs(fact: DataFrame, partitions: int | None = None) -> DataFrame:
    """The daily mart as it is stored: runs of days, as many as things that happened and not as days times merchants."""
    return daily_runs(fact, date_bounds(fact, "transaction_date"), DIMS, partitions)


def mart_daily_metric_values(
    fact: DataFrame,
    start: str | None = None,
    end: str | None = None,
    partitions: int | None = None,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Dense daily series per metric, category, merchant and sources, optionally only some days of it, and with ``derived``
    columns of a row's values without its day."""
    return dense_metrics(fact, date_bounds(fact, "transaction_date"), DIMS, start, end, partitions, derived)


def daily_totals(
    fact: DataFrame,
    start: str | None = None,
    end: str | None = None,
    categories: Sequence[str] | None = None,
    merchants: Sequence[str] | None = None,
    view: str = "all",
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """The daily mart under the user's filters, summed over all dimensions, without building the mart.

    Rolling sums are additive, so the sum of all series equals the series of the sums: the fact is filtered and
    summed to day and metric before any day is filled in. Roll-ups and trends give the same on this frame as on
    the filtered mart, for days times metrics rows instead of days times metrics times merchants.
    """
    chosen = filter_transactions(fact, None, None, categories, merchants)
    totals = dense_metrics(chosen, date_bounds(fact, "transaction_date"), [], start, end)
    return filter_daily_metrics(totals, view=view, groups=groups)
