"""Every registered query against its SQL counterpart in an independent engine, on whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from ledgerspark import registry
from tools.compare import compare, database

FOLDER = os.environ.get("LEDGERSPARK_TEST_DIR", "/root/testdata/sf0.001")
# The smallest data set holds no recurring pattern.
MAY_BE_EMPTY = {
    "mart_recurring_spend", "recurring_visible", "recurring_merchants", "loaded_mart_recurring_spend", "cube_recurring_merchants",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def other_engine():
    connection = database(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(registry.ENTRIES))
def test_same_result(spark, other_engine, name):
    problem = compare(entry.queries()[name](spark, FOLDER), other_engine, entry.oracle_sql().get(name))
    if problem == "no rows" and name in MAY_BE_EMPTY:
        problem = ""
    assert problem == ""


def test_entry_has_rows_and_stable_columns(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["month", "final_category"]
    assert frame.count() > 0


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
