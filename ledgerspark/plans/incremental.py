"""Refresh by load: only the months of a load are read and written again, and the marts follow from month states.

Resolved transactions are stored by month. For each month two states are kept, both a function of its rows alone: how often
every amount occurs by description and resolution, and the first row of every merchant and day. States merge, over months and
over loads, by sums, minima and maxima. Everything that depends on the whole history is worked out from the merged states and
joined to them when it is asked for: means and deviations of merchants and categories, recurrence, z-scores and flags. So a
load that moves a merchant's mean leaves the states of earlier months as they are, and yet all flags follow it.

A load may overlap earlier ones, bring late rows and be run again, also after a failure: rows are known by their id, they are
appended first, and the states of all months of the load are then made anew from the stored rows. Rules and enrichments apply
to the rows of the load; when they change for rows that are stored, ``refresh_whole`` is needed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark.functions.amounts import MONEY, month_bucket
from ledgerspark.operators.aggregates import Measures, median_of_counts
from ledgerspark.operators.joins import null_safe_left_join
from ledgerspark.plans import marts
from ledgerspark.plans.features import FACT_COLUMNS, recurring_keys, with_final_category, with_flags, with_verdict, zscores
from ledgerspark.plans.normalization import known_descriptions, normalize_merchants
from ledgerspark.plans.staging import stage_descriptions, stage_enrichments, stage_transactions
from ledgerspark.session import stored
from ledgerspark.sources.warehouse import Warehouse

RESOLVED, AMOUNTS, DAYS = "resolved_transactions", "month_amounts", "month_merchant_days"
MONTH, MERCHANT, CATEGORY = "month", "normalized_merchant", "final_category"
DIRECTION = ["is_debit", "is_credit"]
AMOUNT_KEYS = [MONTH, *marts.REVIEW_KEYS, *DIRECTION, "amount_abs"]
DAY_KEYS = [MONTH, MERCHANT, "transaction_date"]


def by_month(frame: DataFrame) -> DataFrame:
    return frame.withColumn(MONTH, month_bucket(F.col("transaction_date")))


def amount_states(resolved: DataFrame) -> DataFrame:
    """Rows and first and last day of every amount, by month, description, resolution and direction."""
    day = "transaction_date"
    return with_final_category(resolved).groupBy(*AMOUNT_KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen")
    )


def day_states(resolved: DataFrame) -> DataFrame:
    """The first row of every merchant and day in file order; of equal row numbers the smallest id comes first."""
    first = F.struct("source_row_number", "transaction_id", CATEGORY, "is_debit")
    return with_final_category(resolved).groupBy(*DAY_KEYS).agg(F.min(first).alias("first"))


def merge_amounts(one: DataFrame, other: DataFrame) -> DataFrame:
    """States of two sets of rows without common ids as the state of all of them."""
    return one.unionByName(other).groupBy(*AMOUNT_KEYS).agg(
        F.sum("rows").alias("rows"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def merge_days(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy(*DAY_KEYS).agg(F.min("first").alias("first"))


def moments(amounts: DataFrame, keys: Sequence[str], mean: str, deviation: str, *more: Column) -> DataFrame:
    """Mean and sample deviation of the amounts of each group.

    Both come from exact sums in cents. Squares are summed about a whole number of cents next to the mean, so nothing is lost
    to cancellation and equal amounts have a deviation of exactly 0. The sum of the squares has to stay below 1e38.
    """
    cents, rows = (F.col("amount_abs") * 100).cast("decimal(20,0)"), F.col("rows").cast("decimal(18,0)")
    sums = amounts.groupBy(*keys).agg(
        F.sum(F.when(F.col("amount_abs").isNotNull(), F.col("rows"))).alias("__n"),
        F.sum((cents * rows).cast("decimal(38,0)")).alias("__sum"),
        F.sum((cents * cents * rows).cast("decimal(38,0)")).alias("__squares"),
        *more,
    )
    near = sums.withColumn("__mid", F.expr("cast(__sum div __n as decimal(20,0))"))
    wide, n = "decimal(38,0)", F.col("__n").cast("decimal(18,0)")
    mid, total = F.col("__mid"), F.col("__sum")
    square = (mid * mid).cast(wide)
    about = F.col("__squares") - (mid * total * 2).cast(wide) + (square * n).cast(wide)
    rest = (total - (mid * n).cast(wide)).cast("double")
    count = F.col("__n").cast("double")
    variance = (about.cast("double") - rest * rest / count) / F.nullif(count - 1, F.lit(0.0))
    named = [name for name in sums.columns if not name.startswith("__")]
    return near.select(
        *named,
        (total.cast("double") / F.nullif(F.col("__n") * 100, F.lit(0)).cast("double")).alias(mean),
        (F.sqrt(F.greatest(variance, F.when(variance.isNotNull(), F.lit(0.0)))) / 100).alias(deviation),
    )


def statistics(amounts: DataFrame, key: str, prefix: str) -> DataFrame:
    return moments(amounts, [key], f"{prefix}_avg_amount", f"{prefix}_std_amount")


def recurring_of_states(amounts: DataFrame, days: DataFrame) -> DataFrame:
    """``recurring_transactions`` from merged states.

    The gap to the merchant's previous transaction is 0 for all rows of a day but its first one, so the first rows hold
    the sum of all gaps. No gap is known for the first row of a merchant and for rows without a date.
    """
    debits = amounts.filter("is_debit")
    history = moments(
        debits,
        [MERCHANT, CATEGORY],
        "avg_amount",
        "amount_stddev",
        F.sum("rows").alias("transaction_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.coalesce(F.sum(F.when(F.col(MONTH).isNull(), F.col("rows"))), F.lit(0)).alias("undated"),
    )
    day = "transaction_date"
    previous = F.lag(day).over(Window.partitionBy(MERCHANT).orderBy(day))
    firsts = (
        days.select(MERCHANT, day, "first", F.datediff(day, previous).alias("gap"))
        .filter(F.col("first.is_debit") & F.col(day).isNotNull())
        .groupBy(MERCHANT, F.col(f"first.{CATEGORY}").alias(CATEGORY))
        .agg(F.sum("gap").alias("gaps"), F.count_if(F.col("gap").isNull()).alias("openings"))
    )
    joined = null_safe_left_join(history, firsts, [MERCHANT, CATEGORY])
    none = F.lit(0)
    known = F.col("transaction_count") - F.col("undated") - F.coalesce("openings", none)
    gap = F.coalesce("gaps", none).cast("double") / F.nullif(known, none).cast("double")
    dated = joined.withColumn("avg_days_between_transactions", gap).drop("undated", "gaps", "openings")
    return with_verdict(dated)


def score(rows: DataFrame, merchants: DataFrame, categories: DataFrame) -> DataFrame:
    """The z-scores of any rows, or states, against the present statistics."""
    joined = null_safe_left_join(null_safe_left_join(rows, merchants, [MERCHANT]), categories, [CATEGORY])
    return joined.withColumns(zscores())


def fold(flagged: DataFrame) -> DataFrame:
    """Flagged amounts to one row per month, description, resolution and flags.

    ``amount_abs`` is the sum of the amounts and ``transaction_date`` the month, so that all sums of the marts read the fold as they
    read transactions.
    """
    keys = [MONTH, *marts.REVIEW_KEYS, *DIRECTION, "is_recurring", "is_anomaly"]
    rows, amount = F.col("rows"), F.col("amount_abs")
    folded = flagged.groupBy(*keys).agg(
        F.sum(rows).alias("rows"),
        F.coalesce(F.sum(F.when(amount.isNotNull(), rows)), F.lit(0)).alias("priced_rows"),
        F.max(amount).alias("largest"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum(amount * rows.cast("decimal(18,0)")).cast(MONEY).alias("amount_abs"),
    )
    return folded.withColumn("transaction_date", F.col(MONTH))


class FoldedMeasures(Measures):
    """Measures of folded rows. Medians need the amounts themselves and read the debits of the amount states."""

    def __init__(self, amounts: DataFrame | None = None):
        self.debits = None if amounts is None else amounts.filter("is_debit and amount_abs is not null")

    def count(self, condition: Column | None = None) -> Column:
        rows = F.col("rows") if condition is None else F.when(condition, F.col("rows"))
        return F.coalesce(F.sum(rows), F.lit(0).cast("long"))

    def mean(self, condition: Column | None = None) -> Column:
        amount, rows = F.col(self.amount), F.col("priced_rows")
        if condition is not None:
            amount, rows = F.when(condition, amount), F.when(condition, rows)
        cents = (F.sum(amount) * 100).cast("decimal(38,0)").cast("double")
        return cents / F.nullif(F.sum(rows) * 100, F.lit(0)).cast("double")

    def largest(self) -> Column:
        return F.max("largest")

    def first(self) -> Column:
        return F.min("first_seen")

    def last(self) -> Column:
        return F.max("last_seen")

    def median(self, df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        if self.debits is None:
            raise ValueError("a median needs the amount states")
        counts = self.debits.groupBy(*keys, self.amount).agg(F.sum("rows").alias("rows"))
        return median_of_counts(counts, keys, self.amount, "rows", name)


@dataclass
class Stored:
    """The stored tables that a refresh by load keeps, and what follows from the whole history."""

    resolved: DataFrame
    amounts: DataFrame
    days: DataFrame
    merchants: DataFrame
    categories: DataFrame
    recurring: DataFrame
    steady: DataFrame

    def fact(self, months: Sequence[dt.date | None] | None = None) -> DataFrame:
        """The transactions with the flags and scores of today's history, of all or of some months; only these are read."""
        rows = self.resolved if months is None else self.resolved.filter(in_months(months))
        scored = score(with_final_category(rows), self.merchants, self.categories)
        return with_flags(scored, self.steady).select(*FACT_COLUMNS)


def clustered(frame: DataFrame) -> DataFrame:
    """Rows of a month together, so that a task writes files of few months; AQE splits a large month over many tasks."""
    return frame.hint("rebalance", MONTH)


def loaded_rows(raw: DataFrame) -> DataFrame:
    """The staged rows of a load by month, each id once. Rows are compared and moved as they come, before staging widens them."""
    return by_month(stage_transactions(raw.dropDuplicates(["row_hash"])))


def known_texts(descriptions: DataFrame, rules: DataFrame, enrichments: DataFrame) -> DataFrame:
    """What rules and enrichments say about the distinct descriptions of a load, stored."""
    return stored(known_descriptions(stored(descriptions, "descriptions"), rules, enrichments), "known-descriptions")


def in_months(months: Sequence[dt.date | None]) -> Column:
    """Rows of the given months, as a filter on the partitions of a table."""
    listed = F.col(MONTH).isin([month for month in months if month is not None])
    return listed | F.col(MONTH).isNull() if None in months else listed


def with_history(warehouse: Warehouse, resolved: DataFrame, amounts: DataFrame, days: DataFrame) -> Stored:
    """Statistics of the whole history from the states of all months, stored: a row per merchant, category and both, and
    apart from the rest the pairs that recur."""
    recurring = warehouse.full_refresh_write(recurring_of_states(amounts, days), "recurring_transactions")
    return Stored(
        resolved,
        amounts,
        days,
        warehouse.full_refresh_write(statistics(amounts, MERCHANT, "merchant"), "merchant_statistics"),
        warehouse.full_refresh_write(statistics(amounts, CATEGORY, "category"), "category_statistics"),
        recurring,
        warehouse.full_refresh_write(recurring_keys(recurring), "recurring_keys"),
    )


def refresh_whole(raw: DataFrame, rules: DataFrame, enrichment_cache: DataFrame, warehouse: Warehouse) -> Stored:
    """Replace everything by the rows of one load."""
    enrichments = stage_enrichments(enrichment_cache)
    known = known_texts(stage_descriptions(raw), rules, enrichments)
    resolved = normalize_merchants(loaded_rows(raw), rules, enrichments, known)
    resolved = warehouse.full_refresh_write(clustered(resolved), RESOLVED, [MONTH])
    amounts = warehouse.full_refresh_write(clustered(amount_states(resolved)), AMOUNTS, [MONTH])
    days = warehouse.full_refresh_write(clustered(day_states(resolved)), DAYS, [MONTH])
    return with_history(warehouse, resolved, amounts, days)


def refresh_changed(raw: DataFrame, rules: DataFrame, enrichment_cache: DataFrame, warehouse: Warehouse) -> Stored:
    """Add a load: new ids are resolved and appended, and the states of the load's months are replaced.

    The driver sees the months of the load, no rows. Tables of other months are neither read nor written but for the states,
    which the statistics are merged from. An empty load changes nothing.
    """
    load = stored(loaded_rows(raw), "load")
    months = [row[MONTH] for row in load.select(MONTH).distinct().collect()]
    enrichments = stage_enrichments(enrichment_cache)
    known = known_texts(load.select("raw_description", "clean_description").distinct(), rules, enrichments)
    schema = normalize_merchants(load, rules, enrichments, known).schema
    held = warehouse.declared(RESOLVED, schema).filter(in_months(months))
    new = load.join(held.select("transaction_id"), "transaction_id", "left_anti")
    fresh = normalize_merchants(new.select(*load.columns), rules, enrichments, known)
    resolved = warehouse.append(clustered(fresh), RESOLVED, [MONTH])
    changed = resolved.filter(in_months(months))
    amounts = warehouse.replace_partitions(clustered(amount_states(changed)), AMOUNTS, [MONTH])
    days = warehouse.replace_partitions(clustered(day_states(changed)), DAYS, [MONTH])
    return with_history(warehouse, resolved, amounts, days)


def marts_of_states(held: Stored) -> dict[str, DataFrame]:
    """The marts that are sums over transactions, from the states of all months."""
    flagged = with_flags(score(held.amounts, held.merchants, held.categories), held.steady)
    folded = stored(fold(flagged), "folded")
    by, recurring = FoldedMeasures(held.amounts), marts.mart_recurring_spend(held.recurring)
    return {
        "mart_recurring_spend": recurring,
        "mart_monthly_spend": marts.mart_monthly_spend(folded, by),
        "mart_monthly_kpis": marts.mart_monthly_kpis(folded, by),
        "mart_category_metrics": marts.mart_category_metrics(folded, by),
        "mart_spend_kpis": marts.mart_spend_kpis(folded, recurring, by),
        "mart_data_quality": marts.mart_data_quality(folded, by),
        "mart_merchant_review": marts.mart_merchant_review(folded, by),
    }


def run_load(raw: DataFrame, rules: DataFrame, enrichment_cache: DataFrame, warehouse: Warehouse) -> dict[str, DataFrame]:
    """Add a load to a warehouse and replace its marts; returns the marts and the fact, which is a view of its parts."""
    held = refresh_changed(raw, rules, enrichment_cache, warehouse)
    fact = held.fact()
    found = {**marts_of_states(held), "mart_anomalies": marts.mart_anomalies(fact)}
    written = {name: warehouse.full_refresh_write(frame, name) for name, frame in found.items()}
    return written | {"fct_transactions": fact}
