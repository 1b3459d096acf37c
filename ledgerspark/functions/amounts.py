"""Money, date and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerspark.constants import CHANGE_FLOOR

MONEY = "decimal(18,2)"


def parse_us_date(text: Column) -> Column:
    """``MM/DD/YYYY`` (leading zeros optional) to a date."""
    return F.to_date(text, "M/d/yyyy")


def signed_amount(value: Column) -> dict[str, Column]:
    """Typed amount with its size and direction. A zero is neither debit nor credit."""
    amount = value.cast(MONEY)
    return {
        "amount": amount,
        "amount_abs": F.abs(amount),
        "is_debit": amount < 0,
        "is_credit": amount > 0,
    }


def null_safe_zscore(value: Column, mean: Column, deviation: Column) -> Column:
    return (value.cast("double") - mean) / F.nullif(deviation, F.lit(0.0))


def day_gap(previous: Column, current: Column) -> Column:
    return F.datediff(current, previous)


def month_bucket(day: Column) -> Column:
    return F.trunc(day, "month")


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def guarded_change_pct(current: Column, prior: Column, floor: float = CHANGE_FLOOR) -> Column:
    """Relative change, defined only where the prior value is large enough to compare with."""
    return F.when(prior >= floor, guarded_ratio(current, prior) - 1)


def delta_columns(current: Column, comparison: Column) -> dict[str, Column]:
    return {
        "delta_value": current - comparison,
        "delta_pct": F.when(F.abs(comparison) > 0, guarded_ratio(current, comparison) - 1),
    }


def rounded(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double, so that 0.285 * 100 counts as the 28.499... it is."""
    scale = F.lit(10.0**digits)
    return F.round(value.cast("double") * scale) / scale


def magnitude_bucket(value: Column) -> Column:
    """Monotone bucket number from a value's order of magnitude and three leading digits.

    At most about 35,000 distinct buckets exist however many values there are, so a running total over the
    buckets is always a small job. Equal values share a bucket and larger values never get a smaller number.
    """
    number = value.cast("double")
    size = F.abs(number)
    exponent = F.floor(F.log10(size))
    large = (exponent + 1) * 1000 + F.floor(size * F.pow(F.lit(10.0), F.lit(2) - exponent))
    code = F.when(size < 1, F.floor(size * 100)).otherwise(large).cast("long")
    return F.when(number < 0, -code).otherwise(code)
