"""A table is replaced as a whole or not at all."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerspark.sources.warehouse import Warehouse


def test_a_failed_write_keeps_the_table(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.full_refresh_write(spark.range(10), "t")
    # Some tasks write their files before the last one fails.
    failing = spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(Exception, match="stop"):
        house.full_refresh_write(failing, "t")
    assert sorted(r.id for r in house.table("t").collect()) == list(range(10))


def test_a_failed_swap_keeps_the_table(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.full_refresh_write(spark.range(3), "t")
    with pytest.raises(Exception, match="next-none"):
        house.swap(str(tmp_path / "t.next-none"), house.path("t"))
    assert house.table("t").count() == 3


def test_a_table_may_be_replaced_by_what_reads_it(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    for _ in range(3):
        house.full_refresh_write(house.table("t", spark.range(0).schema).union(spark.range(2)), "t")
    assert house.table("t").count() == 6
    parts = house.full_refresh_write(spark.range(6).withColumn("p", F.col("id") % 2), "t", ["p"])
    assert parts.filter("p = 1").count() == 3
    assert [name for name in os.listdir(tmp_path) if not name.startswith(".")] == ["t"]
