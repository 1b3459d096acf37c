"""Refreshes by load against one refresh of everything."""

from __future__ import annotations

import datetime as dt
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerspark.plans import incremental as inc
from ledgerspark.plans.pipeline import build_layers, build_marts
from ledgerspark.schemas import ENRICHMENT_CACHE
from ledgerspark.sources.warehouse import Warehouse
from tests.frames import RAW_COLUMNS
from tests.test_layers import rules

SCHEMA = ", ".join(f"`{name}` {'long' if name == 'source_row_number' else 'string'}" for name in RAW_COLUMNS)


def raw_rows(seed=5):
    """Charges of nine months with a monthly one, outliers, credits, equal rows, and missing dates, texts and amounts."""
    random.seed(seed)
    texts = ["UBER TRIP", "uber eats", "SAVE 100% NOW", "GYM", "CAFE", "A_B", "odd shop"]
    rows = [(f"{month:02d}/05/2024", "RENT", "Home", "-30.00") for month in range(1, 10)]
    for _ in range(260):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=random.randrange(270))
        amount = random.choice(["-5.00", "-5.00", "-7.25", "-12.10", "3.50", "0", "-900.00" if random.random() < 0.1 else "-6.00"])
        rows.append((day.strftime("%m/%d/%Y"), random.choice(texts), random.choice(["Food", "Travel", None]), amount))
    rows += [(None, "CAFE", "Food", "-4.00"), (None, None, "Food", "-4.00"), ("03/03/2024", None, None, "-8.00"),
             ("03/04/2024", "CAFE", "Food", None), ("03/04/2024", None, None, "-8.00")]
    return [
        (date, date, text, category, "Sale", amount, "", number, "a.csv", "test", "now", f"k{number:04d}")
        for number, (date, text, category, amount) in enumerate(rows, 1)
    ]


def month_of(row):
    return int(row[0][:2]) if row[0] else None


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def inputs(spark):
    return rules(spark), spark.createDataFrame([("odd shop", "Odd", "Gifts", "AI", 0.9, "r", "m", None)], ENRICHMENT_CACHE)


def plain(df, ignore=()):
    names = sorted(set(df.columns) - set(ignore))

    def normal(value):
        return round(value, 8) + 0.0 if isinstance(value, float) else value

    return sorted((tuple(normal(row[name]) for name in names) for row in df.collect()), key=repr)


@pytest.fixture(scope="module")
def whole(spark):
    layers = build_layers(frame(spark, raw_rows()), *inputs(spark))
    marts = build_marts(layers)
    return {"recurring": plain(layers.recurring)} | {
        name: plain(df) for name, df in marts.items() if name not in ("mart_daily_metric_values", "mart_metric_summary")
    }


def loads():
    """Three loads: the second one repeats a month and brings late rows, the third one only late rows and old ones."""
    rows = raw_rows()
    late = [row for place, row in enumerate(rows) if place % 11 == 3 or month_of(row) is None]
    ids = {row[-1] for row in late}
    first = [row for row in rows if row[-1] not in ids and month_of(row) <= 5]
    second = [row for row in rows if row[-1] not in ids and month_of(row) >= 5] + late[::2]
    return [first, second, late[1::2] + late[:4] + late[1::2]]


def compare(found, whole):
    for name, df in found.items():
        assert plain(df) == whole[name], name


def test_loads_give_the_marts_of_one_refresh(spark, whole, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    for load in loads():
        found = inc.run_load(frame(spark, load), *inputs(spark), warehouse)
    assert {row[0] for row in whole["recurring"]} and whole["mart_anomalies"] and whole["mart_recurring_spend"]
    assert set(found) == set(whole) - {"recurring"}
    compare(found, whole)
    assert plain(warehouse.table("recurring_transactions")) == whole["recurring"]
    assert found["fct_transactions"].count() == len(raw_rows())


def test_whole_refresh_replaces_what_was_there(spark, whole, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    other = [(*row[:-1], "x" + row[-1]) for row in raw_rows(6)]
    inc.refresh_whole(frame(spark, other), *inputs(spark), warehouse)
    held = inc.refresh_whole(frame(spark, raw_rows()), *inputs(spark), warehouse)
    compare(inc.marts_of_states(held), whole)


def test_marts_have_the_columns_and_types_of_the_plain_ones(spark, tmp_path):
    held = inc.refresh_whole(frame(spark, raw_rows()), *inputs(spark), Warehouse(spark, str(tmp_path)))
    marts = build_marts(build_layers(frame(spark, raw_rows()), *inputs(spark)))
    for name, df in inc.marts_of_states(held).items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in marts[name].schema], name


def test_states_of_two_loads_merge_to_the_state_of_all(spark, tmp_path):
    resolved = inc.refresh_whole(frame(spark, raw_rows()), *inputs(spark), Warehouse(spark, str(tmp_path))).resolved
    some = F.substring("transaction_id", -1, 1) < "5"
    one, other = resolved.filter(some), resolved.filter(~some)
    for state, merge in ((inc.amount_states, inc.merge_amounts), (inc.day_states, inc.merge_days)):
        assert plain(merge(state(one), state(other))) == plain(state(resolved))


@pytest.mark.parametrize("failing", [inc.AMOUNTS, inc.DAYS])
def test_a_failed_load_is_made_good_by_running_it_again(spark, whole, tmp_path, monkeypatch, failing):
    warehouse = Warehouse(spark, str(tmp_path))
    first, second, third = loads()
    inc.refresh_changed(frame(spark, first + second), *inputs(spark), warehouse)
    replace = Warehouse.replace_partitions

    def broken(self, df, table, partition_by):
        if table == failing:
            raise OSError("lost")
        return replace(self, df, table, partition_by)

    monkeypatch.setattr(Warehouse, "replace_partitions", broken)
    with pytest.raises(OSError):
        inc.refresh_changed(frame(spark, third), *inputs(spark), warehouse)
    monkeypatch.undo()
    held = inc.refresh_changed(frame(spark, third), *inputs(spark), warehouse)
    compare(inc.marts_of_states(held), whole)


def files(root, table):
    return {
        os.path.join(folder, name)
        for folder, _, names in os.walk(os.path.join(root, table)) for name in names if name.endswith(".parquet")
    }


def test_files_of_other_months_stay(spark, tmp_path):
    warehouse, rows = Warehouse(spark, str(tmp_path)), raw_rows()
    old = [row for row in rows if month_of(row) != 4]
    inc.refresh_changed(frame(spark, old), *inputs(spark), warehouse)
    before = {table: files(tmp_path, table) for table in (inc.RESOLVED, inc.AMOUNTS, inc.DAYS)}
    inc.refresh_changed(frame(spark, [row for row in rows if month_of(row) in (3, 4)]), *inputs(spark), warehouse)
    for table, names in before.items():
        now = files(tmp_path, table)
        kept = {name for name in names if "month=2024-03-01" not in name}
        assert kept <= now
        assert {name.split("month=")[1][:10] for name in now - names} <= {"2024-03-01", "2024-04-01"}
    assert before[inc.RESOLVED] <= files(tmp_path, inc.RESOLVED)


def test_asked_months_reach_the_scan(spark, tmp_path):
    held = inc.refresh_whole(frame(spark, raw_rows()), *inputs(spark), Warehouse(spark, str(tmp_path)))
    asked = [dt.date(2024, 3, 1), None]
    some = held.fact(asked)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = some._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and inc.RESOLVED in line)
    assert "month" in scan.split("PartitionFilters: [")[1].split("]")[0]
    wanted = held.fact().filter("transaction_date is null or trunc(transaction_date, 'month') = '2024-03-01'")
    assert plain(some) == plain(wanted)


def test_empty_load_changes_nothing(spark, whole, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    inc.refresh_changed(frame(spark, raw_rows()), *inputs(spark), warehouse)
    before = files(tmp_path, inc.AMOUNTS)
    held = inc.refresh_changed(frame(spark, []), *inputs(spark), warehouse)
    assert files(tmp_path, inc.AMOUNTS) == before
    compare(inc.marts_of_states(held), whole)


def test_first_load_may_be_empty(spark, tmp_path):
    held = inc.refresh_changed(frame(spark, []), *inputs(spark), Warehouse(spark, str(tmp_path)))
    marts = inc.marts_of_states(held)
    assert marts["mart_monthly_kpis"].count() == 0 and marts["mart_spend_kpis"].collect()[0]["transaction_count"] == 0


def test_deviation_does_not_cancel(spark):
    """Cents that differ in the last places of large amounts, and equal amounts of any size."""
    values = ["98765432109.01", "98765432109.03", "98765432109.03", "98765432109.08"]
    rows = [("near", value, 1000) for value in values] + [("same", "77777777777.77", 10**6), ("one", "5.00", 1), ("none", None, 3)]
    states = spark.createDataFrame(rows, "key string, amount_abs string, rows long").withColumn(
        "amount_abs", F.col("amount_abs").cast("decimal(18,2)")
    )
    got = {row["key"]: row for row in inc.moments(states, ["key"], "mean", "deviation").collect()}
    cents = [int(value[-2:]) for value in values] * 1000
    assert got["near"]["deviation"] == pytest.approx(statistics.stdev(cents) / 100, rel=1e-12)
    assert got["same"]["deviation"] == 0.0 and got["same"]["mean"] == 77777777777.77
    assert got["one"]["deviation"] is None and got["one"]["mean"] == 5.0
    assert got["none"]["deviation"] is None and got["none"]["mean"] is None
