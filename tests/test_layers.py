from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators.calendar import date_bounds
from ledgerspark.plans import daily, features, marts, normalization, slices
from ledgerspark.plans.narrative import summary_record
from ledgerspark.plans.pipeline import build_layers, build_marts, run_pipeline
from ledgerspark.plans.staging import stage_transactions
from ledgerspark.schemas import ENRICHMENT_CACHE
from ledgerspark.sources.files import rules_frame
from ledgerspark.sources.warehouse import Warehouse
from tests.frames import day, fact, fact_row, raw, small_fact

RULE_COLUMNS = "pattern string, normalized_merchant string, merchant_group string, default_category string"
RULES = [
    ("UBER", "Uber", "Rideshare", "Travel"),
    ("uber eats", "Uber Eats", "Delivery", "Food"),
    ("EATS UBER", "Equal Length", "Test", "Food"),
    ("100%", "Percent", "Test", "Food"),
    ("A_B", "Underscore", "Test", "Food"),
    ("X", "Short", "Test", None),
]
TEXTS = ["UBER TRIP", "uber eats pizza", "UBER EATS UBER", "SAVE 100% NOW", "SAVE 1000 NOW", "AXB", "A_B", "nothing", ""]


def rules(spark, rows=RULES):
    return rules_frame(spark.createDataFrame(rows, RULE_COLUMNS))


def staged(spark, texts):
    return stage_transactions(raw(spark, [("01/02/2025", text, "Food", "-1.00") for text in texts]))


def best(spark, texts, rule_rows=RULES):
    txn = staged(spark, texts)
    matched = normalization.best_match(normalization.rule_match(txn, rules(spark, rule_rows)))
    joined = txn.select("transaction_id", "raw_description").join(matched, "transaction_id")
    return {row["raw_description"]: row["normalized_merchant"] for row in joined.collect()}


EXPECTED = {
    "UBER TRIP": "Uber", "uber eats pizza": "Uber Eats", "UBER EATS UBER": "Equal Length", "SAVE 100% NOW": "Percent",
    "SAVE 1000 NOW": None, "AXB": "Short", "A_B": "Underscore", "nothing": None, "": None,
}


def test_longest_literal_pattern_wins(spark):
    assert best(spark, TEXTS) == EXPECTED


def test_both_forms_give_the_same_matches(spark):
    frame = normalization.with_best_rule(staged(spark, TEXTS), rules(spark))
    got = {row["raw_description"]: row["__rule"] and row["__rule"]["normalized_merchant"] for row in frame.collect()}
    assert got == EXPECTED
    assert frame.count() == len(TEXTS)


def test_many_rules_on_random_texts(spark):
    random.seed(11)
    letters = "ABC "
    texts = sorted({"".join(random.choices(letters, k=random.randint(1, 12))) for _ in range(300)})
    patterns = sorted({"".join(random.choices("ABC", k=random.randint(1, 7))) for _ in range(60)})
    rows = [(p, f"m-{p}", "g", "c") for p in patterns]
    for text, merchant in best(spark, texts, rows).items():
        found = [p for p in patterns if p in text.strip().upper()]
        wanted = min(found, key=lambda p: (-len(p), p)) if found else None
        assert merchant == (f"m-{wanted}" if wanted else None)


def enrichments(spark):
    rows = [("nothing", "Suggested", None, "AI", 0.70, "r", "m", None), ("AXB", "Ignored", "Food", "AI", 0.99, "r", "m", None),
            ("low", "Low", "Food", "AI", 0.69, "r", "m", None)]
    return spark.createDataFrame(rows, ENRICHMENT_CACHE)


def test_precedence(spark):
    frame = normalization.merchant_normalization(staged(spark, ["nothing", "AXB", "low"]), rules(spark), enrichments(spark))
    got = {row["transaction_id"]: row for row in frame.collect()}
    nothing, rule, low = got["k0001"], got["k0002"], got["k0003"]
    assert (nothing["normalized_merchant"], nothing["merchant_source"], nothing["category_source"]) == (
        "Suggested", "cohere_cache", "chase_raw")
    assert (rule["normalized_merchant"], rule["merchant_source"], rule["rule_category"]) == ("Short", "seed_rule", None)
    assert rule["category_source"] == "cohere_cache"
    assert (low["normalized_merchant"], low["merchant_group"], low["merchant_source"]) == ("low", "Unmapped", "fallback")
    assert low["ai_confidence"] == 0.69 and low["ai_category"] is None


def chain(spark, rows):
    normalized = normalization.normalize_merchants(
        stage_transactions(raw(spark, rows)), rules(spark), spark.createDataFrame([], ENRICHMENT_CACHE)
    )
    frame = features.transaction_features(normalized)
    recurring = features.recurring_transactions(frame)
    return frame, recurring, features.fact_transactions(frame, recurring)


def test_recurring_anomaly_and_grain(spark):
    rows = [(f"{month:02d}/05/2025", "GYM", "Health", "-30.00") for month in range(1, 7)]
    rows += [(f"01/{d:02d}/2025", "CAFE", None, "-5.00") for d in range(1, 12)]
    rows += [("01/20/2025", "CAFE", None, "-80.00"), ("01/20/2025", "CAFE", None, "-80.00"), ("02/01/2025", "ONCE", "Food", "0")]
    frame, recurring, result = chain(spark, rows)
    assert result.count() == len(rows)
    flagged = {row["raw_description"] for row in result.filter("is_recurring").collect()}
    assert flagged == {"GYM"}
    gym = [row for row in recurring.collect() if row["normalized_merchant"] == "GYM"][0]
    assert gym["cadence"] == "monthly" and gym["amount_stddev"] == 0.0
    once = frame.filter("raw_description = 'ONCE'").collect()[0]
    assert once["merchant_std_amount"] is None and once["zscore_vs_merchant"] is None
    assert not once["is_debit"] and not once["is_credit"] and once["final_category"] == "Food"
    same_day = frame.filter("transaction_date = '2025-01-20'").orderBy("source_row_number").collect()
    assert [row["days_since_last_transaction_at_merchant"] for row in same_day] == [9, 0]
    assert {row["final_category"] for row in frame.filter("raw_description = 'CAFE'").collect()} == {"Other"}


def test_gap_counts_credits_and_other_categories(spark):
    rows = [("01/01/2025", "SHOP", "A", "-5.00"), ("01/11/2025", "SHOP", "B", "4.00"), ("01/31/2025", "SHOP", "A", "-5.00")]
    _, recurring, _ = chain(spark, rows)
    line = recurring.filter("final_category = 'A'").collect()[0]
    assert line["avg_days_between_transactions"] == 20.0


def brute_daily(rows, first, last):
    """The dense mart by definition, from plain loops."""
    member = {
        "debit": lambda r: r["is_debit"], "credit": lambda r: r["is_credit"],
        "anomaly": lambda r: r["is_debit"] and r["is_anomaly"],
        "recurring": lambda r: r["is_debit"] and r["is_recurring"],
        "fallback": lambda r: r["is_debit"] and r["merchant_source"] == "fallback",
        "enriched": lambda r: r["is_debit"] and r["merchant_source"] == "cohere_cache",
        "rule": lambda r: r["is_debit"] and r["merchant_source"] == "seed_rule",
    }
    keys = {
        "debit": ("total_spend", "debit_transaction_count"), "credit": ("credit_amount", "credit_transaction_count"),
        "anomaly": ("anomaly_spend", "anomaly_transaction_count"),
        "recurring": ("recurring_spend", "recurring_transaction_count"),
        "fallback": ("fallback_spend", "fallback_transaction_count"),
        "enriched": ("cohere_spend", "cohere_transaction_count"),
        "rule": ("seed_rule_spend", "seed_rule_transaction_count"),
    }
    values = {}
    for row in rows:
        for population, test in member.items():
            if test(row):
                dims = (row["final_category"], row["normalized_merchant"], row["merchant_source"], row["category_source"])
                for key, value in zip(keys[population], (row["amount_abs"], Decimal(1)), strict=True):
                    series = values.setdefault((*dims, key), {})
                    offset = (row["transaction_date"] - day(0)).days
                    series[offset] = series.get(offset, Decimal(0)) + value
    out = {}
    for series, points in values.items():
        for offset in range(first, last + 1):
            def total(end, points=points):
                return sum((points.get(o, Decimal(0)) for o in range(end - 29, end + 1) if o >= first), Decimal(0))

            prior = total(offset - 30) if offset - 30 >= first else None
            out[(*series, day(offset))] = (points.get(offset, Decimal(0)), total(offset), prior)
    return out


def as_mapping(frame):
    return {
        (r["final_category"], r["normalized_merchant"], r["merchant_source"], r["category_source"], r["metric_key"],
         r["metric_date"]): (r["metric_value"], r["metric_value_l30d"], r["metric_value_prior_l30d"])
        for r in frame.collect()
    }


def test_daily_mart_by_definition(spark):
    frame = small_fact(spark)
    mart = daily.mart_daily_metric_values(frame)
    expected = brute_daily(frame.collect(), 0, 79)
    assert as_mapping(mart) == expected
    assert mart.count() == len(expected)
    narrowed = daily.mart_daily_metric_values(frame, "2025-02-10", "2025-02-12")
    assert as_mapping(narrowed) == {key: v for key, v in expected.items() if 40 <= (key[-1] - day(0)).days <= 42}


def test_daily_mart_on_random_facts(spark):
    random.seed(5)
    rows = [
        fact_row(n, random.randint(0, 95), random.choice("AB"), random.choice(["Food", "Home"]),
                 random.choice([-3, -7.5, 2]), random.choice(["fallback", "seed_rule"]), anomaly=random.random() < 0.2)
        for n in range(60)
    ]
    frame = fact(spark, rows)
    bounds = date_bounds(frame, "transaction_date").collect()[0]
    first, last = (bounds["min_date"] - day(0)).days, (bounds["max_date"] - day(0)).days
    assert as_mapping(daily.mart_daily_metric_values(frame)) == brute_daily(frame.collect(), first, last)


@pytest.mark.parametrize("filters", [
    {}, {"categories": ["Food"]}, {"merchants": ["Beta", "Gamma"], "start": "2025-02-01"}, {"view": "credits"},
    {"view": "debits", "groups": ["Spend"], "end": "2025-03-01"},
])
def test_totals_equal_the_filtered_mart(spark, filters):
    from ledgerspark.operators.filters import filter_daily_metrics

    frame = small_fact(spark)
    totals = daily.daily_totals(frame, **filters)
    filtered = filter_daily_metrics(daily.mart_daily_metric_values(frame), **filters)
    for view in (slices.metric_rollup, slices.metric_trend):
        assert [tuple(r) for r in view(totals).collect()] == [tuple(r) for r in view(filtered).collect()]


def test_events_conserve_amounts(spark):
    frame = small_fact(spark)
    events = daily.daily_metric_events(frame)
    spend = events.filter("metric_key = 'total_spend'").agg(F.sum("metric_value")).collect()[0][0]
    assert spend == frame.filter("is_debit").agg(F.sum("amount_abs")).collect()[0][0]
    sparse = daily.daily_values(frame).agg(F.sum("metric_value")).collect()[0][0]
    assert sparse == events.agg(F.sum("metric_value")).collect()[0][0]


def test_marts_of_nothing(spark):
    empty = small_fact(spark).limit(0)
    recurring = spark.createDataFrame([], "estimated_monthly_cost double")
    kpis = marts.mart_spend_kpis(empty, recurring).collect()
    assert len(kpis) == 1 and kpis[0]["total_spend"] == 0 and kpis[0]["top_category"] is None
    assert kpis[0]["top_category_spend_share"] is None
    assert slices.kpi_row(empty).collect()[0]["top_category"] == "—"
    for frame in (marts.mart_metric_summary(empty), daily.mart_daily_metric_values(empty), marts.mart_monthly_kpis(empty)):
        assert frame.count() == 0


def test_change_table_with_missing_dimension_and_zero_prior(spark):
    rows = [fact_row(1, 70, "A", None, -10), fact_row(2, 20, "A", None, -4), fact_row(3, 79, "B", "Food", -1)]
    frame = fact(spark, rows)
    changes = slices.change_table(frame, "raw_category", slices.anchor_date(frame)).collect()
    assert [(r["raw_category"], float(r["delta_amount"]), r["delta_pct"]) for r in changes] == [
        ("Unknown", 6.0, 1.5), ("Food", 1.0, None)]


def test_movers(spark):
    rows = [fact_row(1, 79, "Up", "F", -10), fact_row(2, 40, "Down", "F", -30), fact_row(3, 70, "Same", "F", -5),
            fact_row(4, 30, "Same", "F", -5)]
    frame = fact(spark, rows)
    changes = slices.change_table(frame, "normalized_merchant", slices.anchor_date(frame))

    def name(found):
        lines = found.collect()
        return lines[0]["normalized_merchant"] if lines else None

    assert name(slices.top_mover(changes, "normalized_merchant")) == "Down"
    assert name(slices.directional_mover(changes, "normalized_merchant", "up")) == "Up"
    assert name(slices.primary_mover(changes, "normalized_merchant")) == "Up"
    falling = changes.filter("normalized_merchant <> 'Up'")
    assert name(slices.primary_mover(falling, "normalized_merchant")) == "Down"
    assert name(slices.directional_mover(falling, "normalized_merchant", "up")) is None


def test_summary_of_a_selection(spark):
    frame = small_fact(spark)
    record = summary_record(frame, daily.daily_totals(frame), view="all").collect()
    assert len(record) == 1
    row = record[0]
    assert row["selected_transaction_count"] == 8 and row["selected_credit_count"] == 1
    assert row["summary_card_3_value"] == "Alpha"
    assert "## What's notable" in row["fallback_summary"]
    assert "- Beta | Home | $60.00 across 3 transactions" in row["context_text"]
    assert "- 2025-02-11 | Alpha | $99.99 | because" in row["context_text"]


def test_summary_of_an_empty_selection(spark):
    frame = small_fact(spark)
    nothing = frame.filter("final_category = 'none'")
    row = summary_record(nothing, daily.daily_totals(frame, categories=["none"])).collect()[0]
    assert row["recent_category_label"] == "No change"
    assert row["recent_category_text"] == "No material change versus the prior 30 days."
    assert row["summary_card_3_value"] == "No major anomaly"
    assert "- No daily metric rollups match the current filters." in row["context_text"]
    assert "- No anomalies in the current filters." in row["context_text"]
    assert row["selected_anomaly_share"] is None


def test_whole_pipeline_from_raw_rows(spark):
    rows = [(f"{month:02d}/05/2025", "GYM CLUB", "Health", "-30.00") for month in range(1, 7)]
    rows.append(("06/20/2025", "PAYMENT", None, "100.00"))
    layers = build_layers(raw(spark, rows), rules(spark), spark.createDataFrame([], ENRICHMENT_CACHE))
    produced = build_marts(layers)
    assert produced["fct_transactions"].count() == 7
    assert produced["mart_recurring_spend"].collect()[0]["estimated_monthly_cost"] == 30.0
    assert produced["mart_metric_summary"].count() == 13
    kpis = produced["mart_spend_kpis"].collect()[0]
    assert (kpis["total_spend"], kpis["credit_amount"], kpis["debit_transaction_count"]) == (180, 100, 6)


def test_refresh_of_a_warehouse(spark, tmp_path):
    rows = [("01/02/2025", "UBER TRIP", "Food", "-1.00"), ("02/03/2025", "Café", None, "-4.00"), ("03/04/2025", "UBER TRIP", "Food", "-5.00")]
    house = Warehouse(spark, str(tmp_path))
    cache = spark.createDataFrame([], ENRICHMENT_CACHE)
    marts = run_pipeline(raw(spark, rows), rules(spark), cache, house, start="2025-02-01", end="2025-02-28")
    assert marts["fct_transactions"].count() == 3
    days = {str(row["metric_date"]) for row in marts["mart_daily_metric_values"].select("metric_date").collect()}
    assert min(days) >= "2025-02-01" and max(days) <= "2025-02-28"
    # A second refresh replaces the tables, and a repeated key fails the declared tests.
    twice = raw(spark, rows).union(raw(spark, rows[:1]))
    with pytest.raises(ValueError, match="staged_transactions.transaction_id unique"):
        run_pipeline(twice, rules(spark), cache, house, start="2025-02-01", end="2025-02-28")
    assert house.mart_scan("fct_transactions").count() > 3


def test_declared_tests_report_their_failures(spark):
    from ledgerspark.operators.quality import dq_declared

    frame = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "k string, v int")
    found = dq_declared({"t": frame}, {"t": {"not_null": ["k", "v"], "unique": ["k"]}}).collect()
    assert sorted((r["column_name"], r["test"], r["failures"]) for r in found) == [
        ("k", "not_null", 1), ("k", "unique", 1), ("v", "not_null", 1)]
