"""Slices from the cube against the slices from the transactions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators.filters import filter_transactions
from ledgerspark.plans import cube, slices
from ledgerspark.sources.warehouse import Warehouse
from tests.frames import small_fact

SELECTIONS = [
    {}, {"start": "2025-01-05", "end": "2025-03-01"}, {"categories": ["Food"]}, {"merchants": ["Beta", "Gamma"]},
    {"view": "anomalies"}, {"view": "credits"}, {"start": "2030-01-01"},
]


def rows_of(df):
    return [tuple(row) for row in df.collect()]


def all_slices(chosen, **by):
    anchor = slices.anchor_date(chosen)
    return {
        "kpi_row": slices.kpi_row(chosen, **by),
        "months": slices.spend_by_month_category(chosen).orderBy("month", "final_category"),
        "categories": slices.spend_by_category(chosen),
        "merchants": slices.top_merchants(chosen),
        "days": slices.daily_spend(chosen).orderBy("transaction_date"),
        "windows": slices.rolling_windows(chosen, anchor),
        "changes": slices.change_table(chosen.filter("is_debit"), "final_category", anchor),
        "top": slices.top_categories(chosen),
        "recurring": slices.recurring_merchants(chosen, **by),
    }


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    fact = small_fact(spark).unionByName(small_fact(spark).withColumn("transaction_id", F.concat("transaction_id", F.lit("b"))))
    return fact, cube.write_cube(fact, Warehouse(spark, str(tmp_path_factory.mktemp("cube"))))


@pytest.mark.parametrize("selection", SELECTIONS)
def test_slices_are_those_of_the_fact(both, selection):
    fact, stored = both
    wanted = all_slices(filter_transactions(fact, **selection))
    for name, df in all_slices(filter_transactions(stored, **selection), by=cube.MEASURES).items():
        assert df.columns == wanted[name].columns and rows_of(df) == rows_of(wanted[name]), name


def test_cubes_merge(both):
    fact, stored = both
    second = F.col("transaction_id").endswith("b")
    merged = cube.merge_cubes(cube.day_cube(fact.filter(second)), cube.day_cube(fact.filter(~second)))
    assert sorted(rows_of(merged.select(*stored.columns)), key=repr) == sorted(rows_of(stored), key=repr)
    assert stored.agg(F.sum("rows")).head()[0] == fact.count()


def test_medians_are_refused():
    with pytest.raises(ValueError):
        cube.MEASURES.median(None, [], "median")
