from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark import constants as K
from ledgerspark.functions import amounts, rules, text, vectors


def values(spark, rows, schema, **columns):
    frame = spark.createDataFrame(rows, schema)
    return [tuple(row) for row in frame.select(*[column.alias(name) for name, column in columns.items()]).collect()]


def test_dates_with_and_without_leading_zeros(spark):
    got = values(spark, [("01/02/2025",), ("1/2/2025",)], "d string", day=amounts.parse_us_date(F.col("d")))
    assert got == [(dt.date(2025, 1, 2),), (dt.date(2025, 1, 2),)]


def test_zero_is_neither_debit_nor_credit(spark):
    parts = amounts.signed_amount(F.col("a"))
    got = values(spark, [("-8.88",), ("0",), ("3.5",)], "a string", debit=parts["is_debit"], credit=parts["is_credit"])
    assert got == [(True, False), (False, False), (False, True)]


def test_zscore_is_null_without_spread(spark):
    rows = [(5.0, 4.0, 2.0), (5.0, 5.0, 0.0), (5.0, 5.0, None)]
    score = amounts.null_safe_zscore(F.col("x"), F.col("m"), F.col("s"))
    assert values(spark, rows, "x double, m double, s double", z=score) == [(0.5,), (None,), (None,)]


@pytest.mark.parametrize(
    ("prior", "expected"), [(0.0, None), (49.99, None), (50.0, 1.0), (None, None)]
)
def test_change_needs_a_large_enough_prior(spark, prior, expected):
    change = amounts.guarded_change_pct(F.col("c"), F.col("p"))
    assert values(spark, [(100.0, prior)], "c double, p double", change=change) == [(expected,)]


def test_magnitude_buckets_are_monotone(spark):
    numbers = [-1000.5, -12.3, -0.5, 0.0, 0.01, 0.99, 1.0, 9.99, 10.0, 99.999, 100.0, 999.99, 1000.0, 1001.0, 123456.78]
    got = values(spark, [(n,) for n in numbers], "v double", b=amounts.magnitude_bucket(F.col("v")))
    buckets = [row[0] for row in got]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize(("confidence", "trusted"), [(0.69, False), (0.70, True), (None, False)])
def test_confidence_threshold(spark, confidence, trusted):
    flags = rules.provenance_flags(F.lit(None), F.lit(None), F.col("c"), F.lit("Travel"))
    got = values(spark, [(confidence,)], "c double", **flags)
    assert got == [("cohere_cache", "cohere_cache") if trusted else ("fallback", "chase_raw")]


def test_enriched_merchant_without_category_keeps_raw_category_source(spark):
    flags = rules.provenance_flags(F.lit(None), F.lit(None), F.col("c"), F.lit(None))
    assert values(spark, [(0.9,)], "c double", **flags) == [("cohere_cache", "chase_raw")]


def test_anomaly_reasons_and_unknown_scores(spark):
    rows = [(True, 2.5, 9.0), (True, None, 3.0), (True, 2.4, None), (False, 9.0, 9.0), (True, None, None)]
    flags = rules.anomaly_flag(F.col("d"), F.col("m"), F.col("c"))
    got = values(spark, rows, "d boolean, m double, c double", **flags)
    assert got == [
        (True, K.REASON_MERCHANT), (True, K.REASON_CATEGORY), (False, None), (False, None), (False, None),
    ]


def test_recurrence_limits(spark):
    rows = [(3, 25.0, 3.0, 10.0), (3, 35.0, 15.0, 100.0), (2, 30.0, 0.0, 10.0), (3, 24.9, 0.0, 10.0),
            (3, 30.0, 3.01, 10.0), (3, None, 0.0, 10.0), (3, 30.0, None, 10.0)]
    verdict = rules.recurrence_rule(F.col("n"), F.col("g"), F.col("s"), F.col("m"))
    got = values(spark, rows, "n int, g double, s double, m double", r=verdict)
    assert [row[0] for row in got] == [True, True, False, False, False, False, True]


def test_cadence_and_monthly_cost(spark):
    rows = [(30.0, 10.0), (7.0, 10.0), (12.0, 10.0), (None, 10.0)]
    label = rules.cadence_label(F.col("g"))
    got = values(spark, rows, "g double, a double", c=label, cost=rules.monthly_cost_estimate(label, F.col("a")))
    assert [row[0] for row in got] == ["monthly", "weekly", "irregular", "irregular"]
    assert [row[1] for row in got] == [10.0, pytest.approx(43.3), None, None]


def test_review_rules(spark):
    rows = [("fallback", 3, 10.0, "x", "x"), ("fallback", 1, 250.0, "x", "x"), ("cohere_cache", 1, 1.0, "m", "x"),
            ("fallback", 1, 1.0, "x", "x"), ("seed_rule", 50, 99999.0, "m", "x")]
    schema = "s string, n int, t double, m string, r string"
    got = values(
        spark, rows, schema,
        reason=rules.review_reason(F.col("s"), F.col("n"), F.col("t"), F.col("m"), F.col("r")),
        score=rules.review_priority(F.col("s"), F.col("n"), F.col("t")),
    )
    assert [row[0] for row in got] == [
        K.REVIEW_FREQUENT, K.REVIEW_EXPENSIVE, K.REVIEW_ENRICHED, K.REVIEW_RAW, K.REVIEW_RULE,
    ]
    assert [row[1] for row in got] == [109.1, 105.5, 13.01, 103.01, 100.0]


def test_expansion_follows_synonyms_of_synonyms(spark):
    rows = [("Streaming",), ("the coffee",), ("a x of",), ("movie night",)]
    got = [row[0] for row in values(spark, rows, "q string", t=text.expanded_terms(F.col("q")))]
    assert got[0] == sorted(
        {"streaming", "subscription", "premium", "netflix", "youtube", "spotify", "subscriptions", "membership",
         "recurring", "monthly"}
    )
    assert got[1] == sorted(["coffee", "cafe", "café", "espresso", "latte", "starbucks"])
    assert got[2] == []
    assert "night" in got[3] and "cinema" in got[3]


def test_lexical_score_counts(spark):
    rows = [("coffee bar", ["coffee", "bar", "café", "ice cream"], "Coffee Bar: barista, café, ICE CREAM"),
            ("tea", ["tea"], None), ("tea", ["tea"], "steam")]
    got = values(spark, rows, "q string, t array<string>, d string",
                 s=text.lexical_score(F.col("q"), F.col("t"), F.col("d")))
    # whole query 3, two tokens, one substring (a token stops at the accent), one phrase
    assert [row[0] for row in got] == [3.0 + 1 + 1 + 0.5 + 1.5, 0.0, 3.5]


def test_cosine_edge_cases(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([1.0, 2.0, 2.0], [1.0, 0.0])]
    got = values(spark, rows, "a array<float>, b array<float>", c=vectors.cosine_similarity(F.col("a"), F.col("b")))
    assert [round(row[0], 6) for row in got] == [1.0, 0.0, 0.0, 0.333333]


def test_missing_scores_count_as_zero(spark):
    rows = [(None, 0.38, None), (None, None, None), (0.08, 0.0, 0.0), (None, 0.2, 1.0), (0.04, 0.0, 2.0)]
    columns = [F.col("r"), F.col("s"), F.col("l")]
    got = values(spark, rows, "r double, s double, l double",
                 label=vectors.confidence_label(*columns), keep=vectors.is_confident(*columns))
    assert got == [("high", True), ("low", False), ("medium", True), ("low", True), ("medium", True)]


def test_formats(spark):
    rows = [(1234.5, "currency"), (0.1234, "percent"), (1234.4, "count"), (1.0, "other"), (None, "currency")]
    got = values(spark, rows, "v double, u string", f=text.unit_format(F.col("v"), F.col("u")),
                 s=text.signed_money_text(F.col("v")), m=text.money_text(F.col("v")))
    assert [row[0] for row in got] == ["$1,234.50", "12.3%", "1,234", "1.00", "—"]
    assert got[0][1:] == ("+$1,234.50", "$1,234.50") and got[4][1:] == ("$0.00", "$0.00")


def test_tags(spark):
    rows = [([" Travel", "TRAVEL", "nothing", "bar"], "Home"), ([], "Shopping"), (None, "Home"),
            (K.ALLOWED_TAGS, "Home")]
    got = [row[0] for row in values(spark, rows, "t array<string>, c string",
                                    t=text.normalise_tags(F.col("t"), F.col("c")))]
    assert got == [["travel", "bar"], ["shopping"], ["entertainment"], K.ALLOWED_TAGS[:6]]


def test_content_key_ignores_field_order(spark):
    one = text.content_key(model=F.lit("m"), query=F.col("q"))
    two = text.content_key(query=F.col("q"), model=F.lit("m"))
    first, second = values(spark, [("x",)], "q string", a=one, b=two)[0]
    assert first == second and len(first) == 64


def test_json_slice_takes_the_outermost_object(spark):
    rows = [('Sure {"a": {"b": 1}} bye',), ("none",), ("} {",)]
    got = [row[0] for row in values(spark, rows, "r string", j=text.json_slice(F.col("r")))]
    assert got == ['{"a": {"b": 1}}', None, None]


def test_search_text_defaults(spark):
    schema = ("normalized_merchant string, merchant_group string, final_category string, raw_category string, "
              "raw_description string, transaction_type string, amount_abs decimal(18,2), is_debit boolean, "
              "transaction_date date, is_recurring boolean, is_anomaly boolean, merchant_source string")
    rows = [(None, "", None, "Food", None, None, None, None, None, True, True, None)]
    got = values(spark, rows, schema, t=text.search_text())[0][0]
    assert got == (
        "merchant: Unknown. merchant_group: Unknown. category: Food. raw_description: . transaction_type: Unknown. "
        "amount: $0.00 credit. date: Unknown. signals: recurring, anomaly. merchant_source: Unknown."
    )


def test_signed_money_and_dates_are_units(spark):
    rows = [(-12.5, "signed_currency"), (1234.0, "signed_currency"), (0.0, "signed_currency"), (None, "signed_currency"), (20089.0, "date"), (None, "date")]
    frame = spark.createDataFrame(rows, "v double, u string")
    found = [row[0] for row in frame.select(text.unit_format(F.col("v"), F.col("u"))).collect()]
    assert found == ["-$12.50", "+$1,234.00", "$0.00", "—", "Jan 1, 2025", "—"]
