from __future__ import annotations

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerspark import session
from ledgerspark.sources import files
from ledgerspark.sources.warehouse import Warehouse, lenient_datetime

HEADER = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"


def write(path, lines, header=HEADER, age=0):
    path.write_text("\n".join([header, *lines]) + "\n")
    if age:
        stamp = 1_700_000_000 - age
        os.utime(path, (stamp, stamp))
    return str(path)


def test_scan_projects_required_columns_in_order(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["x,01/02/2025,01/03/2025,\"SHOP, A\",Food,Sale,-1.50,"], "Extra," + HEADER)
    frame = files.csv_scan(spark, path).drop("_metadata")
    assert frame.columns == files.REQUIRED_COLUMNS
    assert frame.collect()[0]["Description"] == "SHOP, A"


def test_missing_columns_are_named_in_order(spark, tmp_path):
    path = write(tmp_path / "a.csv", [], "Transaction Date,Description,Amount")
    with pytest.raises(ValueError, match=r"\['Category', 'Memo', 'Post Date', 'Type'\]"):
        files.csv_scan(spark, path)


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    write(tmp_path / "1.csv", ["01/01/2025,01/01/2025,A,F,Sale,-1,"])
    swapped = "Post Date,Transaction Date,Description,Category,Type,Amount,Memo"
    write(tmp_path / "2.csv", ["01/01/2025,01/01/2025,A,F,Sale,-1,"], swapped)
    with pytest.raises(Exception, match="header|Header"):
        files.csv_scan(spark, str(tmp_path)).drop("_metadata").collect()


def test_latest_file_by_modification_time(spark, tmp_path):
    write(tmp_path / "z_old.csv", ["01/01/2025,01/01/2025,OLD,F,Sale,-1,"], age=1000)
    write(tmp_path / "a_new.CSV", ["01/01/2025,01/01/2025,NEW,F,Sale,-1,"], age=10)
    write(tmp_path / "b_text.txt", ["01/01/2025,01/01/2025,TEXT,F,Sale,-1,"])
    frame = files.latest_file_scan(spark, str(tmp_path))
    assert [row["Description"] for row in frame.collect()] == ["NEW"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.latest_file(spark, str(tmp_path / "none"))


def test_rows_are_numbered_in_file_order_across_blocks(spark, tmp_path):
    first = [f"01/01/2025,01/01/2025,A{n:05d},F,Sale,-1.00," for n in range(5000)]
    second = [f"01/01/2025,01/01/2025,B{n:05d},F,Sale,-1.00," for n in range(3000)]
    write(tmp_path / "1.csv", first)
    write(tmp_path / "2.csv", second)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        frame = files.lineage_columns(files.csv_scan(spark, str(tmp_path)), "demo")
        rows = frame.orderBy("source_row_number").select("Description", "source_row_number", "source_file").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [row["source_row_number"] for row in rows] == list(range(1, 8001))
    assert [row["Description"] for row in rows] == [line.split(",")[2] for line in first + second]
    assert rows[0]["source_file"] == "1.csv" and rows[-1]["source_file"] == "2.csv"


def test_exact_duplicates_get_different_keys(spark, tmp_path):
    line = "01/01/2025,01/01/2025,SAME,F,Sale,-1.00,"
    frame = files.lineage_columns(files.csv_scan(spark, write(tmp_path / "a.csv", [line, line])), "demo")
    keys = [row["row_hash"] for row in files.row_hash_key(frame).collect()]
    assert len(set(keys)) == 2 and all(len(key) == 64 for key in keys)


def test_seed_rules(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("pattern,normalized_merchant,merchant_group,default_category\nDd *,DoorDash,Delivery,Food & Drink\n")
    row = files.seed_scan(spark, str(path)).collect()[0]
    assert (row["pattern"], row["match_text"], row["default_category"]) == ("Dd *", "DD *", "Food & Drink")


def test_refresh_may_read_the_table_it_replaces(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    frame = spark.range(5).withColumn("v", F.col("id") * 2)
    house.full_refresh_write(frame, "t")
    house.full_refresh_write(house.table("t").filter("id > 2"), "t")
    assert sorted(row["id"] for row in house.table("t").collect()) == [3, 4]


def test_mart_scan_orders_and_survives_a_missing_table(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.full_refresh_write(
        spark.createDataFrame([("2025-02", 1), ("2025-01", 2)], "month string, total_spend int").repartition(2),
        "mart_monthly_spend",
    )
    assert [row["month"] for row in house.mart_scan("mart_monthly_spend").collect()] == ["2025-01", "2025-02"]
    missing = house.mart_scan("mart_anomalies", StructType.fromDDL("severity_score double, note string"))
    assert missing.count() == 0 and missing.columns == ["severity_score", "note"]
    with pytest.raises(AnalysisException):
        house.mart_scan("mart_anomalies")


def test_bad_dates_become_null(spark):
    frame = spark.createDataFrame([("2025-01-02", "x"), ("2025-13-99", None)], "a string, b string")
    got = [tuple(row) for row in lenient_datetime(frame, ["a", "b"]).collect()]
    assert got[0][0] is not None and got[0][1] is None and got[1] == (None, None)


class _Cluster:
    """A session that says it runs on a cluster."""

    def __init__(self, folder):
        self.conf = self
        self.sparkContext = self
        self.master = "spark://somewhere"
        self.applicationId = "app"
        self._folder = folder

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self._folder if key == "spark.checkpoint.dir" else default


def test_scratch_folder_comes_from_the_session():
    assert session.scratch_root(_Cluster("hdfs://shared/x/")) == "hdfs://shared/x/ledgerspark"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(_Cluster(None))
