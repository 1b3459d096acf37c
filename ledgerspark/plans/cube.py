"""A stored cube of daily sums that the slices read in place of the fact.

One row stands for all transactions of a day, merchant, category, source and flags. It has the fact's names for all of these, and
``amount_abs`` is the sum, so the filters and every slice made of sums read the cube as they read the fact; slices that count or
average take ``MEASURES``. The cube grows with days and merchants, not with transactions. Cubes of two loads without common ids
merge by the same sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerspark.functions.amounts import MONEY
from ledgerspark.plans.incremental import FoldedMeasures
from ledgerspark.sources.warehouse import Warehouse

DIMENSIONS = [
    "transaction_date", "final_category", "normalized_merchant", "merchant_source",
    "is_debit", "is_credit", "is_recurring", "is_anomaly",
]
CUBE = "transaction_cube"
MEASURES = FoldedMeasures()


def day_cube(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("amount_abs").alias("priced_rows"),
        F.sum("amount_abs").cast(MONEY).alias("amount_abs"),
    )


def merge_cubes(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy(*DIMENSIONS).agg(
        F.sum("rows").alias("rows"),
        F.sum("priced_rows").alias("priced_rows"),
        F.sum("amount_abs").cast(MONEY).alias("amount_abs"),
    )


def write_cube(fact: DataFrame, warehouse: Warehouse) -> DataFrame:
    """Replace the stored cube. Its files are ordered by day, so that a range of days skips row groups."""
    return warehouse.full_refresh_write(day_cube(fact).repartitionByRange("transaction_date").sortWithinPartitions("transaction_date"), CUBE)
