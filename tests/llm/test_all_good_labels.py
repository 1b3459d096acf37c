"""Operator 9 counts every good label, however many there are."""

from __future__ import annotations

import duckdb
import pytest

from ledgerspark.llm import ngram_rules
from ledgerspark.llm.oracles import NGRAM_QUALITY_RULES

GOOD = 20_500


def test_more_good_labels_than_the_former_sample(spark):
    documents = spark.range(GOOD + 500).selectExpr(
        "id as doc_id",
        "concat_ws(' ', transform(sequence(0, 11), i -> concat('w', pmod(xxhash64(id, i), 40 + id % 900)))) as text",
    )
    labels = documents.selectExpr("doc_id", f"cast(doc_id < {GOOD} as int) as quality")
    connection = duckdb.connect()
    connection.register("documents", documents.toArrow())
    connection.register("labels", labels.toArrow())
    expected = {row[0]: row[1:] for row in connection.execute(f"select doc_id, llr, kept from ({NGRAM_QUALITY_RULES})").fetchall()}
    found = {row.doc_id: (row.llr, row.kept) for row in ngram_rules.quality_rules(documents, labels).collect()}
    assert found.keys() == expected.keys()
    assert all(found[i][0] == pytest.approx(expected[i][0], abs=2e-6) and found[i][1] == expected[i][1] for i in found)
