from __future__ import annotations

import glob
import os

import pyarrow.parquet as pq
import pytest

from ledgerspark.plans import daily
from ledgerspark.sources import days, warehouse
from ledgerspark.sources.warehouse import Warehouse
from tests.frames import small_fact

SPANS = "name string, begins date, ends date, amount decimal(28,2)"
ROWS = [("a", "2024-02-27", "2024-03-01", "1.50"), (None, "2024-01-01", "2024-01-01", None), ("b", "1969-12-30", "1970-01-02", "-99999999999999999999.99"),
        ("a", "2024-01-05", "2024-01-04", "7.00")]


def spans(spark):
    frame = spark.createDataFrame(ROWS, "name string, begins string, ends string, amount string")
    return frame.selectExpr("name", "cast(begins as date) begins", "cast(ends as date) ends", "cast(amount as decimal(28,2)) amount")


def test_the_written_daily_mart_is_the_dense_one(spark, tmp_path):
    fact = small_fact(spark)
    written = daily.write_daily_mart(daily.mart_daily_metric_runs(fact), Warehouse(spark, str(tmp_path)), "daily")
    dense = daily.mart_daily_metric_values(fact)
    assert [(f.name, f.dataType) for f in written.schema] == [(f.name, f.dataType) for f in dense.schema]
    assert sorted(map(repr, written.collect())) == sorted(map(repr, dense.collect()))


@pytest.mark.parametrize("block", [1, 3, 500_000])
def test_days_equal_those_of_sparks_writer(spark, tmp_path, monkeypatch, block):
    """Also before 1970, without values, for spans without days and when blocks are small; written twice, the second stays."""
    monkeypatch.setattr(days, "ROWS", block)
    house = Warehouse(spark, f"file://{tmp_path}")
    house.full_refresh_days(spans(spark).limit(1), "mine", "day")
    mine = house.full_refresh_days(spans(spark), "mine", "day")
    monkeypatch.setattr(warehouse, "local_path", lambda path: None)
    theirs = house.full_refresh_days(spans(spark).where("begins <= ends"), "theirs", "day")
    assert mine.columns == theirs.columns == ["name", "day", "amount"]
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, theirs.collect())) and mine.count() == 4 + 1 + 4
    files = glob.glob(f"{tmp_path}/mine/*.parquet")
    groups = [pq.ParquetFile(file).metadata.row_group(0).num_rows for file in files]
    assert files and max(groups) <= max(block, 4)


def test_no_rows_make_an_empty_table(spark, tmp_path):
    assert Warehouse(spark, str(tmp_path)).full_refresh_days(spans(spark).where("false"), "none", "day").collect() == []


def test_a_failed_attempt_is_not_read(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.full_refresh_days(spans(spark), "daily", "day")
    kept = house.table("daily").count()
    with open(os.path.join(tmp_path, "daily", "_part-left.snappy.parquet"), "wb") as left:
        left.write(b"half a file")
    assert house.table("daily").count() == kept
    broken = spans(spark).selectExpr("name", "begins", "if(name = 'b', cast(raise_error('broken') as date), ends) as ends", "amount")
    with pytest.raises(Exception, match="broken"):
        house.full_refresh_days(broken, "daily", "day")
    assert house.table("daily").count() == kept


def test_folders_that_tasks_cannot_open_are_told_apart():
    assert days.local_path("/a/b") == days.local_path("file:/a/b") == days.local_path("file:///a/b") == "/a/b"
    assert days.local_path("viewfs://store/a") is None and days.local_path("hdfs:///a") is None
