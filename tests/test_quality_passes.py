"""Many declared tests in one pass over a table."""

from __future__ import annotations

from ledgerspark.operators.quality import dq_columns, dq_declared
from ledgerspark.session import stored

SCHEMA = "id string, other long, day date, note string"


def findings(frame):
    return {(r["column_name"], r["test"]): r["failures"] for r in frame.collect()}


def test_failures_by_column_and_test(spark):
    rows = [("a", 1, None, "x"), ("a", 2, None, None), ("b", 2, None, "x"), ("b", 2, None, "x"), (None, None, None, "x"), (None, 3, None, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert findings(dq_columns(frame, ["id", "day", "note"], ["id", "other", "note"])) == {
        ("id", "not_null"): 2, ("day", "not_null"): 6, ("note", "not_null"): 1,
        ("id", "unique"): 2, ("other", "unique"): 1, ("note", "unique"): 1,
    }
    assert findings(dq_columns(frame, [], ["day"])) == {("day", "unique"): 0}
    assert findings(dq_columns(frame.limit(0), ["id"], ["id"])) == {("id", "not_null"): 0, ("id", "unique"): 0}


def test_one_scan_and_one_exchange_of_values(spark):
    table = stored(spark.createDataFrame([("a", 1, None, "x")] * 50, SCHEMA), "tested")
    found = dq_declared({"t": table}, {"t": {"not_null": ["id", "day"], "unique": ["id", "other", "note"]}})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert findings(found) == {("id", "not_null"): 0, ("day", "not_null"): 50, ("id", "unique"): 1, ("other", "unique"): 1, ("note", "unique"): 1}


def test_rows_that_lack_nothing_are_dropped_first(spark):
    frame = spark.range(10).selectExpr("id as a", "if(id < 3, null, id) as b")
    found = dq_columns(stored(frame, "nulls"), ["a", "b"])
    assert {(r.column_name, r.failures) for r in found.collect()} == {("a", 0), ("b", 3)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter (isnull(a")
