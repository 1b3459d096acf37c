"""Transactions are not moved to meet small tables."""

from __future__ import annotations

import datetime as dt

from ledgerspark.plans import features, normalization
from ledgerspark.plans.staging import stage_descriptions, stage_enrichments, stage_transactions
from ledgerspark.schemas import ENRICHMENT_CACHE
from ledgerspark.session import stored
from tests.frames import raw
from tests.test_layers import rules
from tests.test_plan_shapes import plan

TEXTS = ["UBER", " uber eats", "Shop", None, "", "Garage"]


def inputs(spark):
    loaded = raw(spark, [("01/01/2025", text, "Food", "-1.00") for text in TEXTS])
    known = ("Garage", "Motors", "Travel", "Automotive", 0.9, "why", "m", dt.datetime(2024, 1, 1))
    return loaded, rules(spark), stage_enrichments(spark.createDataFrame([known], ENRICHMENT_CACHE))


def test_transactions_stay_where_they_are_when_few_descriptions_are_known(spark):
    loaded, listed, enrichments = inputs(spark)
    staged = stored(stage_transactions(loaded), "moves-staged")
    descriptions = stored(stage_descriptions(loaded), "moves-descriptions")
    known = stored(normalization.known_descriptions(descriptions, listed, enrichments), "moves-known")
    found = normalization.normalize_merchants(staged, listed, enrichments, known)
    plain = normalization.normalize_merchants(staged, listed, enrichments)
    assert "Exchange hashpartitioning" not in plan(found)
    assert found.schema == plain.schema
    assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)
    assert known.count() < descriptions.count()


def test_flags_meet_only_the_pairs_that_recur(spark):
    columns = "normalized_merchant string, final_category string, is_recurring boolean"
    pairs = spark.createDataFrame([("A", "x", True), ("B", "x", False), ("C", "x", None)], columns)
    assert [row[0] for row in features.recurring_keys(pairs).collect()] == ["A"]
    scored = spark.createDataFrame(
        [(name, "x", True, 0.0, 0.0) for name in "ABCD"],
        "normalized_merchant string, final_category string, is_debit boolean, zscore_vs_merchant double, zscore_vs_category double",
    )
    flagged = features.with_flags(scored, pairs).select("normalized_merchant", "is_recurring")
    assert dict(tuple(row) for row in flagged.collect()) == {"A": True, "B": False, "C": False, "D": False}
    assert "is_recurring" in plan(flagged).split("PushedFilters")[0]
