from __future__ import annotations

import datetime as dt
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import aggregates, caches, calendar, joins, ordering, quality, windows
from tests.frames import day, fact, fact_row


def test_exact_median_equals_sorting(spark):
    random.seed(7)
    rows = []
    for key in ("a", "b", "c", None):
        for _ in range({"a": 1, "b": 2, "c": 501, None: 40}[key]):
            rows.append((key, Decimal(random.choice([1, 10, 100, 12345, 7])) / 100 * random.randint(1, 999)))
    rows.append(("d", None))
    frame = spark.createDataFrame(rows, "k string, v decimal(18,2)")
    got = {row["k"]: row["median"] for row in aggregates.exact_median(frame, ["k"], "v").collect()}
    expected = {
        key: float(statistics.median([v for k, v in rows if k == key and v is not None]))
        for key in ("a", "b", "c", None)
    }
    assert got == pytest.approx(expected)
    overall = aggregates.exact_median(frame, [], "v").collect()[0]["median"]
    assert overall == pytest.approx(float(statistics.median([v for _, v in rows if v is not None])))


def test_median_of_one_dominant_value(spark):
    rows = [("hot", Decimal("19.99"))] * 3000 + [("hot", Decimal(i)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "k string, v decimal(18,2)")
    assert aggregates.exact_median(frame, ["k"], "v").collect()[0]["median"] == 19.99


def test_mean_is_exact_and_null_for_nothing(spark):
    frame = spark.createDataFrame([("a", Decimal("0.10"))] * 3 + [("b", None)], "k string, v decimal(18,2)")
    got = dict(frame.groupBy("k").agg(aggregates.mean("v").alias("m")).collect())
    assert got == {"a": 0.1, "b": None}


def test_lag_dates_follow_date_and_tie(spark):
    random.seed(3)
    rows = [(n, random.choice(["hot", "hot", "cold", None]), day(random.randint(0, 30))) for n in range(400)]
    frame = spark.createDataFrame(rows, "n long, m string, d date")
    got = {row["n"]: row["p"] for row in windows.lag_date_window(frame, "m", "d", "n", "p").collect()}
    last, expected = {}, {}
    for number, merchant, date in sorted(rows, key=lambda r: (r[2], r[0])):
        expected[number] = last.get(merchant)
        last[merchant] = date
    assert got == expected


def test_partition_stats_keep_rows_of_a_missing_key(spark):
    frame = spark.createDataFrame([(1, None, Decimal(2)), (2, None, Decimal(4)), (3, "x", Decimal(5))],
                                  "n long, k string, v decimal(18,2)")
    got = {row["n"]: (row["c_avg_amount"], row["c_std_amount"])
           for row in windows.partition_stats_window(frame, "k", "v", "c").collect()}
    assert got[1] == (3.0, pytest.approx(2**0.5)) and got[3] == (5.0, None)


def test_global_row_number_is_dense_under_ties(spark):
    rows = [(n, n % 3) for n in range(2000)]
    frame = spark.createDataFrame(rows, "n long, v int").repartition(7)
    numbered = windows.global_row_number(frame, [F.desc("v"), F.asc("n")], "place").collect()
    expected = {row: place for place, row in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {(row["n"], row["v"]): row["place"] for row in numbered} == expected


def test_densify_and_rolling_against_plain_python(spark):
    random.seed(1)
    facts = {(random.choice("ab"), day(random.randint(0, 70))): Decimal(random.randint(1, 9)) for _ in range(25)}
    frame = spark.createDataFrame([(k, d, v) for (k, d), v in facts.items()], "k string, d date, v decimal(18,2)")
    bounds = spark.createDataFrame([(day(0), day(75))], "min_date date, max_date date")
    dense = calendar.densify(frame, bounds, ["k"], "d", "v")
    rolled = windows.rolling_sum_30(dense, ["k"], "d", "v", "r")
    got = {(row["k"], row["d"]): (row["v"], row["r"], row["p"])
           for row in windows.lag_offset_30(rolled, ["k"], "d", "r", "p").collect()}

    def window_sum(key, offset):
        return sum((facts.get((key, day(o)), Decimal(0)) for o in range(max(offset - 29, 0), offset + 1)), Decimal(0))

    expected = {
        (key, day(offset)): (
            facts.get((key, day(offset)), Decimal(0)),
            window_sum(key, offset),
            window_sum(key, offset - 30) if offset >= 30 else None,
        )
        for key in "ab" for offset in range(76)
    }
    assert got == expected


def test_date_spine_of_nothing_is_empty(spark):
    assert calendar.date_spine(spark.createDataFrame([], "d date"), "d").count() == 0


def test_period_bucket_edges(spark):
    frame = spark.createDataFrame([(day(o),) for o in (0, 40, 41, 70, 71, 100)], "d date")
    got = {(row["d"] - day(0)).days: row["period_name"] for row in calendar.period_bucket(frame, "d").collect()}
    assert got == {41: "comparison", 70: "comparison", 71: "current", 100: "current"}


def test_upsert_keeps_the_latest_and_prefers_new(spark):
    schema = "k string, m string, v int, created_at timestamp"
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    cache = spark.createDataFrame([("a", "x", 1, early), ("b", "x", 2, late), ("c", "x", 3, early)], schema)
    new = spark.createDataFrame(
        [("a", "x", 10, early), ("b", "x", 20, early), ("d", "x", 40, late), ("d", "x", 41, late)], schema
    )
    got = {row["k"]: row["v"] for row in caches.cache_upsert(cache, new, ["k", "m"]).collect()}
    assert got == {"a": 10, "b": 2, "c": 3, "d": 41}


def test_stale_split(spark):
    docs = spark.createDataFrame([("1", "same"), ("2", "changed"), ("3", "new")], "transaction_id string, search_text string")
    cache = spark.createDataFrame(
        [("1", "m", "same"), ("2", "m", "before"), ("3", "other", "new")],
        "transaction_id string, embedding_model string, search_text string",
    )
    split = caches.stale_cache_split(docs, cache, "transaction_id", "search_text", "m")
    assert {row["transaction_id"]: row["status"] for row in split.collect()} == {"1": "hit", "2": "stale", "3": "new"}
    assert caches.backfill_stats(split).collect()[0].asDict() == {
        "document_count": 3, "cache_hits": 1, "embedded_now": 2, "stale_rows": 1,
    }


def test_optional_row_attaches_as_nulls(spark):
    left = spark.createDataFrame([(1,), (2,)], "n int")
    empty = spark.createDataFrame([], "a int, b string")
    got = joins.left_join_on_true(left, empty).collect()
    assert [tuple(row) for row in got] == [(1, None, None), (2, None, None)]


def test_null_safe_outer_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("x", 1), (None, 2)], "k string, l int")
    right = spark.createDataFrame([(None, 5), ("y", 7)], "k string, r int")
    got = {row["k"]: (row["l"], row["r"]) for row in joins.null_safe_outer_join(left, right, "k", "l", "r").collect()}
    assert got == {"x": (1, 0), None: (2, 5), "y": (0, 7)}


def test_fewer_groups_than_asked_for(spark):
    frame = fact(spark, [fact_row(1, 0, "A", "Food", -1), fact_row(2, 1, "B", "Food", -2)])
    assert aggregates.top_n_sum(frame, "normalized_merchant", "amount_abs", 5, "s").collect()[0]["s"] == Decimal("3.00")
    nothing = aggregates.top_n_sum(frame.limit(0), "normalized_merchant", "amount_abs", 5, "s")
    assert nothing.collect()[0]["s"] == Decimal("0.00")


def test_latest_month_against_calendar_month_before(spark):
    rows = [("a", dt.date(2025, 3, 1), 5), ("a", dt.date(2025, 1, 1), 9), ("b", dt.date(2025, 2, 1), 4)]
    frame = spark.createDataFrame(rows, "k string, month date, v int")
    got = {row["k"]: (int(row["latest_month_spend"]), int(row["prior_month_spend"]))
           for row in aggregates.latest_vs_prior_month(frame, "k", "month", "v").collect()}
    assert got == {"a": (5, 0), "b": (0, 4)}


def test_lag_partitioned_uses_the_observed_month(spark):
    rows = [("a", dt.date(2025, 1, 1), 10), ("a", dt.date(2025, 3, 1), 15)]
    frame = spark.createDataFrame(rows, "k string, month date, v int")
    got = windows.lag_partitioned(frame, "k", "month", "v").orderBy("month").collect()
    assert [(row["mom_change_amount"], row["mom_change_pct"]) for row in got] == [(None, None), (5, 0.5)]


def test_display_order_puts_unknown_keys_last(spark):
    frame = spark.createDataFrame([("zzz",), ("credit_amount",), ("total_spend",)], "metric_key string")
    got = [(row["metric_key"], row["sort_order"]) for row in ordering.display_order_sort(frame, "metric_key").collect()]
    assert got == [("total_spend", 0), ("credit_amount", 12), ("zzz", 999)]


def test_quality_findings(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "id int, v string")
    assert {tuple(row) for row in quality.dq_not_null(frame, ["id", "v"]).collect()} == {("id", 0), ("v", 1)}
    assert [tuple(row) for row in quality.dq_unique(frame, "id").collect()] == [(1, 2)]
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        quality.dq_required_columns(frame, ["y", "id", "x"])


def test_description_samples_are_the_first_in_order(spark):
    rows = [("m", f"text {n:02d}") for n in (5, 3, 9, 1, 1, 7, 2, 8)] + [("o", None)]
    frame = spark.createDataFrame(rows, "k string, v string")
    got = {row["k"]: row["samples"] for row in aggregates.description_samples(frame, "k", "v").collect()}
    assert got == {"m": ["text 01", "text 02", "text 03", "text 05", "text 07", "text 08"]}


def test_top_k_of_a_hot_group_with_ties(spark):
    rows = [("hot", n, n % 5) for n in range(3000)] + [("cold", 1, 9), ("cold", 2, 9)]
    frame = spark.createDataFrame(rows, "k string, n long, v int").repartition(6)
    ranked = windows.top_k_per_group(frame, ["k"], [F.desc("v"), F.asc("n")], 7, "n", "place")
    got = {(row["k"], row["place"]): row["n"] for row in ranked.collect()}
    expected = {("hot", place): n for place, n in enumerate([4, 9, 14, 19, 24, 29, 34], 1)}
    assert got == {**expected, ("cold", 1): 1, ("cold", 2): 2}


def test_upsert_into_an_empty_cache(spark):
    schema = "k string, v int, created_at timestamp"
    new = spark.createDataFrame([("a", 1, None), ("a", 2, dt.datetime(2024, 1, 1))], schema)
    assert [tuple(row)[:2] for row in caches.cache_upsert(new.limit(0), new, ["k"]).collect()] == [("a", 2)]
