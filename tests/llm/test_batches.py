"""What a Python worker is given at once, and how many workers a task needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.llm import common, packing


def test_whole_texts_come_in_small_batches(spark):
    texts = spark.range(0, 3_000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 1_000).alias("text"))
    seen = common.arrow_rows(texts, "n int", lambda rows: {"n": [len(rows["text"])]}).collect()
    assert sum(row.n for row in seen) == 3_000
    assert max(row.n for row in seen) * 10_000 < 2 * common.BATCH_BYTES


def test_packing_runs_one_python_function_in_a_task(spark):
    rows = [(doc, 0, 0, length, doc) for doc in range(700) for length in (1, 7, 1024)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces)
    assert packed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    found = packed.collect()
    assert len(found) == len(rows)
    spots = {(row.sequence_id, row.offset + place) for row in found for place in range(row.length)}
    assert len(spots) == sum(row[3] for row in rows)
