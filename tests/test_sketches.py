"""Sketches of days, merged over ranges, within their error of the exact values."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import sketches
from ledgerspark.session import stored

FIRST = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(1)
    rows = []
    for n in range(30_000):
        group = "hot" if n % 3 else draw.choice(["a", "b", None])  # two thirds are one group
        rows.append((FIRST + dt.timedelta(days=draw.randrange(40)), group, f"user{draw.randrange(9000)}", draw.lognormvariate(3, 1)))
    rows += [(FIRST, "none", None, None)] * 5
    frame = spark.createDataFrame(rows, "day date, kind string, user string, amount double")
    return rows, stored(sketches.daily_sketches(frame, "day", ["kind"], ["user"], ["amount"]), "daily")


@pytest.mark.parametrize("first, last", [(0, 39), (5, 5), (10, 29)])
def test_ranges_are_within_the_bounds(made, first, last):
    rows, daily = made
    start, end = (str(FIRST + dt.timedelta(days=n)) for n in (first, last))
    merged = sketches.merged_sketches(daily, "day", ["kind"], start, end)
    shares = (0.1, 0.5, 0.9)
    found = merged.select(
        "kind", "row_count", sketches.about_distinct("user").alias("users"),
        *[sketches.about_quantile("amount", share).alias(f"q{i}") for i, share in enumerate(shares)],
    ).collect()
    chosen = [row for row in rows if start <= str(row[0]) <= end]
    assert {row.kind for row in found} == {row[1] for row in chosen}
    for row in found:
        own = [r for r in chosen if r[1] == row.kind]
        assert row.row_count == len(own)
        users = len({r[2] for r in own if r[2] is not None})
        assert abs(row.users - users) <= 1 + 0.03 * users
        amounts = [r[3] for r in own if r[3] is not None]
        for i, share in enumerate(shares):
            if not amounts:
                assert row[f"q{i}"] is None
            else:
                assert sum(a < row[f"q{i}"] for a in amounts) / len(amounts) <= share + 0.02
                assert sum(a <= row[f"q{i}"] for a in amounts) / len(amounts) >= share - 0.02


def test_days_reach_the_scan_and_no_group_is_shuffled_whole(made):
    _, daily = made
    plan = sketches.merged_sketches(daily, "day", ["kind"], "2024-01-05", "2024-01-06")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day,2024-01-05)" in plan
    assert plan.index("partial_kll_merge") > plan.index("Exchange")  # below it: combined before the shuffle


def test_an_added_day_leaves_the_others(spark, made):
    rows, daily = made
    late = spark.createDataFrame([(FIRST + dt.timedelta(days=50), "a", "new user", 1.0)], "day date, kind string, user string, amount double")
    added = daily.unionByName(sketches.daily_sketches(late, "day", ["kind"], ["user"], ["amount"]))
    before = sketches.merged_sketches(daily, "day", ["kind"], None, "2024-02-10").select("kind", sketches.about_distinct("user")).collect()
    after = sketches.merged_sketches(added, "day", ["kind"], None, "2024-02-10").select("kind", sketches.about_distinct("user")).collect()
    assert sorted(map(str, before)) == sorted(map(str, after))
    assert sketches.merged_sketches(added, "day", ["kind"]).agg(F.sum("row_count")).collect()[0][0] == len(rows) + 1
