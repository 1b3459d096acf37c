"""Operator 13: the flow against all flows, the result's law, and a layout whose unmoved files stay."""

from __future__ import annotations

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import resharding


def least_cost(supply, demand, cost):
    """The cheapest way to send all units, by trying every one."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    slots = [j for j, n in enumerate(demand) for _ in range(n)]
    return min(sum(cost[i][j] for i, j in zip(units, order)) for order in set(itertools.permutations(slots)))


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest(seed):
    draw = random.Random(seed)
    m, n = draw.randint(1, 3), draw.randint(1, 4)
    supply = [draw.randint(0, 3) for _ in range(m)]
    demand = [0] * n
    for _ in range(sum(supply)):
        demand[draw.randrange(n)] += 1
    cost = [[draw.randint(0, 5) for _ in range(n)] for _ in range(m)]
    flow = resharding.minimum_cost_flow(supply, demand, cost)
    assert flow.sum(axis=1).tolist() == supply and flow.sum(axis=0).tolist() == demand and (flow >= 0).all()
    assert int((flow * np.array(cost)).sum()) == least_cost(supply, demand, cost)


def test_only_the_excess_moves():
    supply = [10**12, 5, 0, 3 * 10**11]
    shares = resharding.capacities(sum(supply), 4)
    flow = resharding.minimum_cost_flow(supply, shares, [[int(i != j) for j in range(4)] for i in range(4)])
    assert int(flow.sum() - np.trace(flow)) == sum(max(0, size - share) for size, share in zip(supply, shares))


def test_chosen_blocks_come_close():
    draw = np.random.default_rng(2)
    for amount in (0, 10, 50_000, 400_000):
        sizes = draw.integers(1, 2000, 500)
        picked = resharding.chosen(sizes, amount)
        assert abs(int(sizes[picked].sum()) - amount) <= 5
    assert not resharding.chosen(np.array([100, 200]), 20).any()


def check_law(rows, texts, shards):
    """Whole, gapless and even; returns the rows."""
    assert sorted((row.text_crc32, row["size"]) for row in rows) == sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for t in texts)
    by_shard = {}
    for row in rows:
        assert row.law == "bytes" and row.grown_shard is None and 0 <= row.shard < shards
        by_shard.setdefault(row.shard, []).append(row)
    for found in by_shard.values():
        assert sorted(row.slot for row in found) == list(range(len(found)))
    return [sum(row["size"] for row in by_shard.get(shard, [])) for shard in range(shards)]


def test_whole_documents(spark, documents, texts):
    rows = resharding.reshard(documents, resharding.by_source()).collect()
    sizes = check_law(rows, texts.values(), 8)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8
    before = [sum(row["size"] for row in rows if row.old_shard == shard) for shard in range(8)]
    moved = sum(row["size"] for row in rows if row.shard != row.old_shard)
    least = sum(max(0, size - share) for size, share in zip(before, resharding.capacities(sum(before), 8)))
    assert abs(moved - least) < 0.01 * least


def test_equal_rows_without_ids_are_spread(spark):
    """A third of all rows is one text without an id; a shard is given up, and some rows were in none."""
    rows = [(None, "the same text", 0)] * 1500 + [(i, "x" * (i % 90), i % 12) for i in range(3000)] + [(9000 + i, None, None) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, home int").repartition(6)
    found = resharding.reshard(table, F.col("home"), shards=5, blocks=128).collect()
    sizes = check_law(found, [text for _, text, _ in rows], 5)
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 5
    assert all(0 <= row.shard < 5 for row in found) and {row.old_shard for row in found} == {None, *range(12)}


def test_odd_rows_and_empty_tables(spark, odd):
    rows = resharding.reshard(odd, resharding.by_source("source")).collect()
    check_law(rows, [row.text for row in odd.select("text").collect()], 8)
    assert resharding.reshard(odd.limit(0), F.lit(0)).collect() == []


def files_of(folder):
    return {
        os.path.join(at, name): os.stat(os.path.join(at, name)).st_mtime_ns
        for at, _, names in os.walk(folder)
        for name in names
        if name.endswith(".parquet")
    }


def test_only_affected_files_are_written(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 30), "a" if i % 3 else "b") for i in range(800)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    folder = str(tmp_path / "layout")
    layout = resharding.write_layout(documents, F.when(F.col("doc_id") < 600, 0).otherwise(1), folder, blocks=32)
    before = files_of(folder)
    after = resharding.rewrite(layout, folder, shards=3)
    assert {name: time for name, time in files_of(folder).items() if name in before} == before
    read = resharding.read_layout(after)
    assert sorted(tuple(row.row) for row in read.select("row").collect()) == sorted(rows)
    sizes = {r.shard: r.bytes for r in read.groupBy("shard").agg(F.sum(resharding.size_of("row`.`text")).alias("bytes")).collect()}
    assert set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values())
    was = {row.row.doc_id: (row.shard, row.part) for row in resharding.read_layout(layout).collect()}
    now = {row.row.doc_id: (row.shard, row.part) for row in read.collect()}
    moved = [i for i in was if was[i] != now[i]]
    assert 0 < len(moved) < 600
    # Written again is what moved, no more.
    written = after.join(layout, ["shard", "part", "path"], "left_anti")
    assert {row.part for row in written.collect()} == {was[i][1] for i in moved}
    assert resharding.rewrite(after, folder, shards=3).join(after, ["shard", "part", "path"], "left_anti").count() <= 2


def test_rows_move_whole_and_others_stay(spark, odd):
    """The result is read from shards in which all columns of a moved row were written again, and nothing else was."""
    rows = [(i, f"text {i} " * (i % 30), i % 7, f"more {i}") for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, home int, more string").repartition(4)
    lies = resharding.move_rows(table, F.when(F.col("home") < 5, F.lit(0)).otherwise(F.col("home") - 4), shards=3, blocks=32)
    assert sorted(tuple(row.record) for row in lies.stayed.unionByName(lies.moved).select("record").collect()) == sorted(rows)
    moved = {row.record.doc_id for row in lies.moved.collect()}
    assert 0 < len(moved) < 600 and moved.isdisjoint(row.record.doc_id for row in lies.stayed.collect())
    held = spark.read.parquet(lies.new_path)
    assert {row.record.doc_id for row in held.collect()} == moved and {row.record.more for row in held.collect()} == {f"more {i}" for i in moved}
    assert all(row.shard != row.old for row in held.collect())
    assert {row.old for row in spark.read.parquet(lies.old_path).collect()} == {0, 1, 2}
    everything = resharding.move_rows(odd, resharding.by_source("source"))
    kept = everything.stayed.unionByName(everything.moved).select("record.*")
    assert kept.columns == odd.columns and kept.exceptAll(odd).isEmpty() and odd.exceptAll(kept).isEmpty()


def test_checksums_are_of_what_arrived(spark):
    table = spark.createDataFrame([(i, "abc" * i, i % 2) for i in range(60)], "doc_id long, text string, home int")
    found = resharding.reshard(table, F.col("home"), shards=3, blocks=8)
    files = found.inputFiles()
    assert any("new-shards" in name for name in files) and any("old-shards" in name for name in files)
    assert len(found.collect()) == 60
