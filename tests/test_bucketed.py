"""Caches in buckets against the plain upsert."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators.caches import cache_upsert
from ledgerspark.sources.bucketed import SLOT, BucketedCache

SCHEMA = "k string, m string, v long, created_at long"
KEYS = ["k", "m"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(row) for row in df.select("k", "m", "v", "created_at").collect()), key=repr)


def cache(spark, path, **sizes):
    return BucketedCache(spark, str(path), frame(spark, []).schema, KEYS, **({"slots": 8, "buckets": 8} | sizes))


def batch(seed, size=120):
    random.seed(seed)
    return [(f"key {random.randrange(90)}", random.choice("ab"), random.randrange(10**6), random.randrange(5)) for _ in range(size)]


def files(root):
    return {os.path.join(at, name) for at, _, names in os.walk(root) for name in names if name.endswith(".parquet")}


def test_batches_equal_the_plain_upsert(spark, tmp_path):
    stored, plain = cache(spark, tmp_path / "it's"), frame(spark, [])
    for seed in range(3):
        new = frame(spark, batch(seed) + batch(seed)[:5])
        plain = frame(spark, rows_of(cache_upsert(plain, new, KEYS)))
        assert rows_of(stored.upsert(new)) == rows_of(plain)
    again = stored.upsert(frame(spark, batch(2)))
    assert rows_of(again) == rows_of(plain)
    asked = frame(spark, [("key 1", "a", None, None), ("key 1", "a", 5, None), ("none", "b", None, None)])
    assert rows_of(stored.lookup(asked)) == [row for row in rows_of(plain) if row[:2] == ("key 1", "a")]


def test_untouched_slots_keep_their_files(spark, tmp_path):
    stored = cache(spark, tmp_path)
    stored.upsert(frame(spark, batch(1)))
    new = frame(spark, [("key 3", "a", 1, 9)])
    slot = stored.slotted(new).collect()[0][SLOT]
    before = files(tmp_path)
    stored.upsert(new)
    touched = f"{SLOT}={slot}{os.sep}"
    assert {name for name in before if touched not in name} == {name for name in files(tmp_path) if touched not in name}
    assert not {name for name in before if touched in name} & files(tmp_path)
    assert ("key 3", "a", 1, 9) in rows_of(stored.frame())


def test_the_cache_is_not_moved(spark, tmp_path):
    stored = cache(spark, tmp_path)
    stored.upsert(frame(spark, batch(1)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        new = frame(spark, batch(2))
        for plan in (stored.merged(new, [0, 1]), stored.lookup(new)):
            text = plan._jdf.queryExecution().executedPlan().toString()
            lines = text.splitlines()
            scan = next(place for place, line in enumerate(lines) if "FileScan" in line)
            depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
            above = []
            for line in reversed(lines[:scan]):
                at = len(line) - len(line.lstrip(" :+-"))
                if at < depth:
                    above.append(line)
                    depth = at
            assert any("Join" in line for line in above)
            join = next(place for place, line in enumerate(above) if "Join" in line)
            assert not [line for line in above[:join] if "Exchange" in line], text
            assert "Bucketed: true" in lines[scan]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_touched_slots_are_read(spark, tmp_path):
    stored = cache(spark, tmp_path)
    stored.upsert(frame(spark, batch(1)))
    plan = stored.merged(frame(spark, []), [3])._jdf.queryExecution().executedPlan().toString()
    assert f"{SLOT}" in next(line for line in plan.splitlines() if "PartitionFilters" in line).split("PartitionFilters: [")[1].split("]")[0]


def test_a_cache_is_opened_again(spark, tmp_path):
    first = cache(spark, tmp_path)
    first.upsert(frame(spark, batch(1)))
    held = rows_of(first.frame())
    spark.sql(f"drop table {first.name}")
    assert rows_of(cache(spark, tmp_path).frame()) == held


def test_empty_batches_and_missing_values(spark, tmp_path):
    stored = cache(spark, tmp_path)
    assert rows_of(stored.upsert(frame(spark, []))) == []
    stored.upsert(frame(spark, [("a", "b", None, None)]))
    before = files(tmp_path)
    stored.upsert(frame(spark, []))
    assert files(tmp_path) == before and rows_of(stored.frame()) == [("a", "b", None, None)]


def test_a_failed_upsert_is_made_good_by_running_it_again(spark, tmp_path):
    stored = cache(spark, tmp_path)
    stored.upsert(frame(spark, batch(1)))
    held, new = rows_of(stored.frame()), frame(spark, batch(2))
    broken = new.withColumn("v", F.when(F.col("created_at") == 4, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        stored.upsert(broken)
    assert rows_of(stored.frame()) == held
    wanted = rows_of(cache_upsert(frame(spark, held), new, KEYS))
    assert rows_of(stored.upsert(new)) == wanted
