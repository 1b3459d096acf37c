"""Small literal inputs shared by the tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

FACT_SCHEMA = (
    "transaction_id string, transaction_date date, raw_description string, normalized_merchant string, "
    "merchant_group string, merchant_source string, category_source string, raw_category string, "
    "final_category string, transaction_type string, amount decimal(18,2), amount_abs decimal(18,2), "
    "is_debit boolean, is_credit boolean, is_recurring boolean, is_anomaly boolean, anomaly_reason string, "
    "zscore_vs_merchant double, zscore_vs_category double"
)
START = dt.date(2025, 1, 1)


def day(offset: int) -> dt.date:
    return START + dt.timedelta(days=offset)


def fact_row(number, offset, merchant, category, amount, source="fallback", recurring=False, anomaly=False):
    value = Decimal(str(amount))
    return (
        f"t{number:04d}", day(offset), merchant, merchant, "Unmapped" if source == "fallback" else "Group", source,
        "chase_raw", category, category, "Sale" if value < 0 else "Payment", value, abs(value), value < 0, value > 0,
        recurring, anomaly, "because" if anomaly else None, 3.0 if anomaly else 0.5, None,
    )


def fact(spark, rows):
    return spark.createDataFrame(rows, FACT_SCHEMA)


def small_fact(spark):
    """Two merchants in two categories over about eighty days, with a credit, an anomaly and a recurring charge."""
    rows = [
        fact_row(1, 0, "Alpha", "Food", -10),
        fact_row(2, 0, "Alpha", "Food", -5.25),
        fact_row(3, 7, "Beta", "Home", -20, source="seed_rule", recurring=True),
        fact_row(4, 20, "Alpha", "Food", 4),
        fact_row(5, 33, "Beta", "Home", -20, source="seed_rule", recurring=True),
        fact_row(6, 41, "Alpha", "Home", -99.99, anomaly=True),
        fact_row(7, 64, "Beta", "Home", -20, source="seed_rule", recurring=True),
        fact_row(8, 79, "Gamma", "Food", -1, source="cohere_cache"),
    ]
    return fact(spark, rows)


RAW_COLUMNS = [
    "Transaction Date", "Post Date", "Description", "Category", "Type", "Amount", "Memo", "source_row_number",
    "source_file", "source_mode", "ingested_at", "row_hash",
]


def raw(spark, rows):
    """Raw rows from (date, description, category, amount) with a row number and a key."""
    complete = [
        (date, date, text, category, "Sale", amount, "", number, "a.csv", "test", "now", f"k{number:04d}")
        for number, (date, text, category, amount) in enumerate(rows, 1)
    ]
    schema = ", ".join(
        f"`{name}` {'long' if name == 'source_row_number' else 'string'}" for name in RAW_COLUMNS
    )
    return spark.createDataFrame(complete, schema)
