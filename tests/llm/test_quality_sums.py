"""Operator 9 sums ratios over rows; the verdicts are those of its form on arrays."""

from __future__ import annotations

import pytest

from ledgerspark.llm import ngram_rules

TEXTS = [
    None, "", " \n\t", "one", "one two", "one one one", "a b c d e f g h i j k", "a b c d e " * 4, "x # y $ z\nx # y $ z\n", "wörter sind größer \u00a0 als ß " * 3,
]


@pytest.mark.parametrize("ids", ["long", "string"])
def test_sums_over_rows_equal_those_over_arrays(spark, ids):
    rows = [(number, text) for number, text in enumerate(TEXTS)] + [(3, "one"), (None, "one two three"), (None, "one two three")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {ids}) as doc_id", "text").repartition(3)
    labels = spark.createDataFrame([(4, 1), (6, 1), (9, 0)], "doc_id long, quality int").selectExpr(f"cast(doc_id as {ids}) as doc_id", "quality")
    found = ngram_rules.quality_rules(documents, labels)
    ratios = ngram_rules.bucket_ratios(ngram_rules.bucket_counts(documents, labels))
    arrays = ngram_rules.judged(documents, ratios).select(found.columns)
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in arrays.schema]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, arrays.collect())) and found.count() == len(rows)


def test_no_function_on_arrays_sums_ratios(spark):
    """Such functions are interpreted for each n-gram; made as rows, the n-grams compile and are summed within the task."""
    documents = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = ngram_rules.quality_rules(documents, labels)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ratios[lambda" not in plan and "partial_sum" in plan and "HashAggregate(keys=[row" in plan
