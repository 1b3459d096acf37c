"""Business rules as expressions: provenance, anomalies, recurrence, review queue."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerspark import constants as K
from ledgerspark.functions.amounts import rounded


def accepted(confidence: Column, suggestion: Column) -> Column:
    """A suggestion counts only from the confidence threshold up; an unknown confidence never counts."""
    return F.when(confidence >= K.ENRICHMENT_CONFIDENCE, suggestion)


def provenance_flags(
    rule_merchant: Column, rule_category: Column, confidence: Column, suggested_category: Column
) -> dict[str, Column]:
    trusted = F.coalesce(confidence >= K.ENRICHMENT_CONFIDENCE, F.lit(False))
    return {
        "merchant_source": F.when(rule_merchant.isNotNull(), K.SOURCE_RULE)
        .when(trusted, K.SOURCE_ENRICHED)
        .otherwise(K.SOURCE_FALLBACK),
        "category_source": F.when(rule_category.isNotNull(), K.SOURCE_RULE)
        .when(trusted & suggested_category.isNotNull(), K.SOURCE_ENRICHED)
        .otherwise(K.SOURCE_RAW_CATEGORY),
    }


def final_category(rule: Column, enriched: Column, raw: Column) -> Column:
    return F.coalesce(rule, enriched, raw, F.lit(K.OTHER_CATEGORY))


def anomaly_flag(is_debit: Column, merchant_z: Column, category_z: Column) -> dict[str, Column]:
    """An unknown score never flags; the merchant reason wins over the category reason."""
    by_merchant = F.coalesce(is_debit & (merchant_z >= K.MERCHANT_Z), F.lit(False))
    by_category = F.coalesce(is_debit & (category_z >= K.CATEGORY_Z), F.lit(False))
    return {
        "is_anomaly": by_merchant | by_category,
        "anomaly_reason": F.when(by_merchant, K.REASON_MERCHANT).when(by_category, K.REASON_CATEGORY),
    }


def severity_score(merchant_z: Column, category_z: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.coalesce(merchant_z, zero), F.coalesce(category_z, zero))


def recurrence_rule(occurrences: Column, mean_gap: Column, deviation: Column, mean: Column) -> Column:
    tolerance = F.greatest(mean * K.AMOUNT_TOLERANCE, F.lit(float(K.AMOUNT_TOLERANCE_FLOOR)))
    steady = F.coalesce(deviation, F.lit(0.0)) <= tolerance
    regular = (occurrences >= K.MIN_RECURRENCES) & mean_gap.between(*K.MONTHLY_GAP)
    return F.coalesce(regular & steady, F.lit(False))


def cadence_label(mean_gap: Column) -> Column:
    return (
        F.when(mean_gap.between(*K.MONTHLY_GAP), "monthly")
        .when(mean_gap.between(*K.WEEKLY_GAP), "weekly")
        .otherwise("irregular")
    )


def monthly_cost_estimate(cadence: Column, mean: Column) -> Column:
    return F.when(cadence == "monthly", mean).when(cadence == "weekly", mean * K.WEEKS_PER_MONTH)


def needs_review_flag(source: Column, group: Column, merchant: Column, raw: Column) -> Column:
    doubtful = (source == K.SOURCE_FALLBACK) | (group == K.UNMAPPED_GROUP) | (merchant == raw)
    return F.coalesce(doubtful, F.lit(False))


def review_reason(source: Column, occurrences: Column, spend: Column, merchant: Column, raw: Column) -> Column:
    fallback = source == K.SOURCE_FALLBACK
    return (
        F.when(fallback & (occurrences >= K.REVIEW_MIN_COUNT), K.REVIEW_FREQUENT)
        .when(fallback & (spend >= K.REVIEW_MIN_SPEND), K.REVIEW_EXPENSIVE)
        .when(source == K.SOURCE_ENRICHED, K.REVIEW_ENRICHED)
        .when(merchant == raw, K.REVIEW_RAW)
        .otherwise(K.REVIEW_RULE)
    )


def review_priority(source: Column, occurrences: Column, spend: Column) -> Column:
    weight = (
        F.when(source == K.SOURCE_FALLBACK, K.REVIEW_WEIGHT_FALLBACK)
        .when(source == K.SOURCE_ENRICHED, K.REVIEW_WEIGHT_ENRICHED)
        .otherwise(0)
    )
    frequency = F.least(occurrences, F.lit(K.REVIEW_COUNT_CAP)) * K.REVIEW_POINTS_PER_COUNT
    size = F.least(spend.cast("double") / K.REVIEW_SPEND_PER_POINT, F.lit(float(K.REVIEW_SPEND_CAP)))
    return rounded(weight + frequency + size, 2)
