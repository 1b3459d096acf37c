"""Classifiers on held-out rows, and the pipeline against its stages."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest

from ledgerspark.llm import packing, ranking, severity

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("the given tables are not here")
    return spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")


def area(scores: np.ndarray, labels: np.ndarray) -> float:
    good, bad = scores[labels == 1], scores[labels == 0]
    return float((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)


def test_quality_on_held_out_rows(tables):
    documents, labels = tables
    rows = ranking.score(documents, ranking.train(documents, labels)).join(labels, "doc_id").collect()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) for row in rows)
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.3) for row in rows)
    held = [row for row in rows if row.held_out]
    assert area(np.array([row.score for row in held]), np.array([row.quality for row in held])) > 0.95


def test_ranking_learns_the_order_of_a_feature():
    draw = np.random.default_rng(1)
    matrix = draw.normal(size=(400, ranking.FEATURES))
    labels = (matrix[:, 3] + 0.2 * draw.normal(size=400) > -0.5).astype(int)
    model = ranking.fit(matrix, labels)
    assert area(model.strength(matrix), labels) > 0.95
    accepted = model.score(matrix) >= 0.3
    assert abs(accepted.mean() - labels.mean()) < 0.02  # the threshold is a quantile at the share of bad rows
    assert ranking.fit(matrix, np.ones(400)) is None


def test_toxicity_on_held_out_rows(tables):
    documents, labels = tables
    model = severity.train(documents, labels.where("doc_id % 4 <> 0"))
    held = labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "label")
    scored = severity.score(documents, model).join(held, "doc_id").collect()
    rows = [row.asDict() | {"toxic": row.label} for row in scored]
    clean = [row for row in scored if row.label == 0]
    wrong = [row for row in clean if row["toxic"]]
    assert len(clean) > 50 and len(wrong) <= 0.05 * len(clean), (len(wrong), len(clean))
    assert area(np.array([row["expected_severity"] for row in rows]), np.array([row["toxic"] for row in rows])) > 0.85  # some 200 rows to learn from


def test_severity_is_ordered():
    draw = random.Random(2)
    marks = [f"bad{i}" for i in range(12)]
    rows, counts = [], []
    for i in range(1500):
        many = draw.choice([0, 0, 0, 1, 3, 6])
        words = [f"w{draw.randrange(300)}" for _ in range(40)] + draw.sample(marks, many)
        rows.append(np.array(severity.text_features(" ".join(words))))
        counts.append(many)
    counts = np.array(counts)
    grades = severity.grades_of(rows, (counts > 0).astype(int))
    assert (grades[counts == 0] == 0).all() and (grades[counts > 0] > 0).all() and set(grades) >= {0, 1, 2}
    assert grades[counts == 6].min() > grades[counts == 1].max()
    model = severity.fit(rows, grades)
    assert (np.diff(model.thresholds) >= 0).all()
    expected = [model.exceedance(np.array([model.strength(" ".join(marks[:n]))])).sum() for n in (0, 1, 3, 6)]
    assert expected == sorted(expected) and expected[-1] > expected[0] + 1


def test_pipeline_stages(spark, tables):
    import corpus_pipeline
    from ledgerspark.session import stored

    documents, labels = tables
    before, at = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, LARGER), name)
        at[name] = (before, after)
        if name != "best_fit_packing":
            assert after.columns == documents.columns
        before = after

    def ids(frame):
        return {row.doc_id for row in frame.select("doc_id").collect()}

    first, kept = at["quality_classifier"]
    accepted = ranking.score(first, ranking.train(first, labels)).where("predicted = 1")
    assert ids(kept) == ids(accepted)

    from ledgerspark.llm import hamming, ngram_rules, skip_chain

    first, kept = at["quality_rules"]
    assert ids(kept) == ids(ngram_rules.quality_rules(first, labels).where("kept"))
    first, kept = at["near_duplicates"]
    assert ids(kept) == {row.component_id for row in hamming.near_duplicates(first).collect()}
    first, kept = at["personal_data"]
    model = skip_chain.train(first)
    texts = {row.doc_id: row.text for row in first.collect()}
    for row in kept.collect():
        assert row.text == skip_chain.mask_text(texts[row.doc_id], model.spans(texts[row.doc_id])[1])
        assert row.n_chars == len(row.text)
    first, packed = at["best_fit_packing"]
    assert ids(packed) == ids(first)
    used = packed.groupBy("sequence_id").sum("length").collect()
    assert max(row["sum(length)"] for row in used) <= 1024
    assert isinstance(packing.plan_bins({1: 1}, 4, 4, 16).sequences, int)
