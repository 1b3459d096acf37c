"""Vectors meet the transactions last."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark import testbed
from ledgerspark.session import stored
from tests.test_plan_shapes import plan


def test_vectors_are_not_moved_by_transaction(spark):
    folder = "/root/testdata/sf0.001"
    ids = stored(spark.range(100).select(F.col("id").cast("string").alias("transaction_id")), "moves-ids")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(testbed.with_vectors(ids, spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = text[text.index("hashpartitioning(transaction_id"):]
    assert "ReadSchema: struct<o_orderkey" in below and text.index("hashpartitioning(vec_id") < text.index("hashpartitioning(transaction_id")
