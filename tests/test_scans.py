"""Windows over one series against the window of an engine that holds it whole."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import scans


@pytest.mark.parametrize("block_rows", [7, 30, 64, 1 << 16])
@pytest.mark.parametrize("size", [0, 1, 6, 7, 8, 200])
def test_equal_plain_loops(spark, size, block_rows):
    random.seed(size)
    values = [random.choice([None, random.randrange(-50, 50)]) for _ in range(size)]
    rows = [(place * 3, value) for place, value in enumerate(values)]
    random.shuffle(rows)
    df = scans.with_positions(spark.createDataFrame(rows, "day long, v long"), [F.col("day").asc()])
    df = scans.rolling_sum_series(df, "position", "v", "rolling", 5, block_rows)
    df = scans.lag_series(df, "position", "v", "earlier", 6, block_rows)
    df = scans.running_total(df, "position", "v", "total", block_rows)
    got = [(r.position, r.v, r.rolling, r.earlier, r.total) for r in df.orderBy("position").collect()]

    def added(some):
        known = [value for value in some if value is not None]
        return sum(known) if known else None

    assert got == [
        (i, v, added(values[max(0, i - 4):i + 1]), values[i - 6] if i >= 6 else None, added(values[:i + 1]))
        for i, v in enumerate(values)
    ]


def test_frames_wider_than_a_block_are_refused(spark):
    with pytest.raises(ValueError):
        scans.lag_series(spark.range(3).withColumnRenamed("id", "position"), "position", "position", "x", 9, 8)


def test_a_long_series_runs_in_many_tasks(spark):
    """Ten million days in 153 blocks, whose values are spread over the tasks."""
    days = 10_000_000
    value = (F.col("position") * 7919 % 1009).alias("v")
    series = spark.range(0, days, 1, 16).withColumnRenamed("id", "position").select("position", value)
    df = scans.running_total(scans.rolling_sum_series(series, "position", "v", "rolling"), "position", "v", "total")
    df = df.withColumn("task", F.spark_partition_id())
    got = df.agg(
        F.count("*").alias("n"), F.sum(F.col("rolling") * (F.col("position") % 97)).alias("r"),
        F.sum(F.col("total") % 1_000_003).alias("t"), F.count_distinct("task").alias("tasks"),
    ).collect()[0]
    wanted = duckdb.sql(f"""select count(*), sum(rolling * (p % 97))::long, sum(total % 1000003)::long from (
        select p, sum(v) over (order by p rows 29 preceding) as rolling, sum(v) over (order by p) as total
        from (select range as p, range * 7919 % 1009 as v from range({days})))""").fetchall()[0]
    assert (got.n, got.r, got.t) == wanted
    assert got.tasks > 1
