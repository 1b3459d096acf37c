from __future__ import annotations

import os

import numpy as np
import pytest

from ledgerspark.plans import vector_index
from ledgerspark.plans.vector_index import build_vector_index, vector_search

FOLDER = "/root/testdata/sf0.1"


def nearest(ids, matrix, asked, k):
    """For each asked vector its k best (score, id), by scoring every pair."""
    length = np.linalg.norm(matrix, axis=1) * np.linalg.norm(asked, axis=1)[:, None]
    scores = asked @ matrix.T / length
    order = [np.lexsort((ids, -row.round(12)))[:k] for row in scores]
    return [[(row[at], ids[at]) for at in best] for row, best in zip(scores, order)]


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(1)
    middles = draw.normal(size=(30, 16))
    matrix = middles[draw.integers(0, 30, 3000)] + 0.4 * draw.normal(size=(3000, 16))
    matrix[1000:2000] = matrix[5]  # a third are copies
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "doc_id long, embedding array<double>")
    return matrix, frame.repartition(4)


def by_query(frame):
    found = {}
    for row in frame.collect():
        found.setdefault(row.query_id, []).append((row["rank"], row.doc_id, row.semantic_score))
    return {query: [row[1:] for row in sorted(rows)] for query, rows in found.items()}


def test_all_cells_are_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 300)  # the copies fill several slices
    matrix, frame = vectors
    asked = matrix[::75]
    queries = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(asked)], "query_id long, embedding array<double>")
    index = build_vector_index(frame, "doc_id")
    assert index.vectors.count() == 3000 and index.vectors.agg({"slices": "max"}).collect()[0][0] >= 3
    found = by_query(vector_search(queries, index, 60, probes=None))
    for at, best in enumerate(nearest(np.arange(3000), matrix, asked, 60)):
        assert [score for _, score in found[at]] == pytest.approx([score for score, _ in best], abs=1e-9)
        assert len({doc for doc, _ in found[at]}) == 60


def recall(index, queries, k):
    exact, fast = (by_query(vector_search(queries, index, k, probes)) for probes in (None, 0))
    held = [sum(score >= exact[q][-1][1] - 1e-12 for _, score in fast.get(q, [])) / len(exact[q]) for q in exact]
    return sum(held) / len(held)


def test_recall_on_clusters(spark, vectors):
    matrix, frame = vectors
    queries = frame.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = build_vector_index(frame, "doc_id")
    assert recall(index, queries, 60) >= 0.9 and index.probes < len(index.centres) / 4


def test_recall_on_the_given_vectors(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("the given tables are not here")
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    index = build_vector_index(frame, "vec_id")
    assert index.vectors.count() == frame.count()
    queries = frame.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact, fast = (
        {(r.query_id, r.vec_id) for r in vector_search(queries, index, 60, probes).collect()} for probes in (None, 0)
    )
    assert len(fast & exact) / len(exact) >= 0.9
    print(f"recall {len(fast & exact) / len(exact):.3f} with {index.probes} of {len(index.centres)} cells")


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 2.0, 5.0]), (5, []), (6, [1.0])]
    frame = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    queries = frame.withColumnRenamed("doc_id", "query_id")
    found = by_query(vector_search(queries, build_vector_index(frame, "doc_id"), 3, probes=None))
    assert set(found) == {1, 4, 6} and [doc for doc, _ in found[1]][:2] == [1, 6]
    empty = build_vector_index(frame.limit(0), "doc_id")
    assert vector_search(queries, empty, 3).collect() == []


def test_scores_and_ties_are_those_of_the_expression(spark, vectors, monkeypatch):
    """Every bit as ``cosine_similarity`` gives it, and copies by id, however the queries and vectors are dealt."""
    from pyspark.sql import functions as F

    from ledgerspark.functions.vectors import cosine_similarity

    monkeypatch.setattr(vector_index, "SLICE_ROWS", 700)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 9)
    frame = vectors[1]
    queries = frame.where("doc_id % 100 = 5").withColumnRenamed("doc_id", "query_id")
    index = build_vector_index(frame, "doc_id")
    pairs = queries.select("query_id", F.col("embedding").alias("asked")).crossJoin(frame)
    best = {}
    for row in pairs.select("query_id", "doc_id", cosine_similarity(F.col("embedding"), F.col("asked")).alias("score")).collect():
        best.setdefault(row.query_id, []).append((-row.score, row.doc_id))
    found = by_query(vector_search(queries, index, 60, probes=None))
    assert found == {query: [(doc, -score) for score, doc in sorted(rows)[:60]] for query, rows in best.items()}


def test_few_rows_are_left_to_rank(spark, vectors):
    """What is ranked grows with queries times tiles, not with pairs."""
    frame = vectors[1]
    queries = frame.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    plan = vector_search(queries, build_vector_index(frame, "doc_id"), 5, probes=None)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan
