"""Scores of tiles: no row for a pair is shuffled, queries stream in blocks, and every tile leaves few rows of a query."""

from __future__ import annotations

import random

import pytest

from ledgerspark.plans import lexical_index, search

SCHEMA = "query_id long, query_text string, embedding array<float>"


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(9)
    words = ["".join(draw.choices("abcd", k=draw.choice([2, 3, 5]))) for _ in range(400)]
    docs = [(n, " ".join(draw.choices(words, k=40))) for n in range(900)]
    asked = [(n, " ".join(draw.choices(words, k=draw.choice([1, 3, 12]))), None) for n in range(150)]
    # More points than a byte holds, whole texts as queries, a phrase of a synonym, and a query of stop words only.
    asked += [(500, " ".join(words), None), (501, docs[3][1], None), (502, docs[700][1][5:60], None), (503, "groceries", None), (504, "to the", None)]
    docs += [(5000, " ".join(words)), (5001, "whole foods and trader joe"), (5002, "go to the door"), (5003, None)]
    return spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def rows(frame):
    return sorted((r["query_id"], r["doc_id"], r["lexical_score"]) for r in frame.collect())


@pytest.mark.parametrize("tile, block, at_once", [(4096, 2048, 256), (100, 7, 3)])
def test_blocks_and_tiles_of_any_size(made, monkeypatch, tile, block, at_once):
    for name, value in (("TILE_ROWS", tile), ("BLOCK_ROWS", block), ("ROWS_AT_ONCE", at_once)):
        monkeypatch.setattr(lexical_index, name, value)
    queries, docs = made
    index = lexical_index.build_lexical_index(docs, "text", "doc_id")
    full = rows(search.lexical_search(queries, docs, "text"))
    assert rows(lexical_index.indexed_search(queries, index)) == full and max(score for _, _, score in full) > 255 * lexical_index.POINT
    best = {}
    for query, doc, score in full:
        best.setdefault(query, []).append((-score, doc))
    found = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in lexical_index.indexed_top_k(queries, index, 5).collect())
    assert found == sorted((q, n, doc) for q, held in best.items() for n, (_, doc) in enumerate(sorted(held)[:5], 1))


def test_no_pair_is_shuffled(made):
    """Pairs are summed where they are made: nothing is moved after the step that makes them."""
    queries, docs = made
    index = lexical_index.build_lexical_index(docs, "text", "doc_id")
    plan = lexical_index.pair_scores(queries, index)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_a_tile_leaves_k_rows_of_a_query(made):
    queries, docs = made
    index = lexical_index.build_lexical_index(docs, "text", "doc_id")
    left = lexical_index.pair_scores(queries, index, 3).groupBy("query_id").count().collect()
    assert len(left) > 100 and max(row["count"] for row in left) <= 3 * index.tiles


def test_tiles_grow_with_documents(spark):
    docs = spark.range(10_000).selectExpr("id as doc_id", "concat('word', id % 7) as text")
    index = lexical_index.build_lexical_index(docs, "text", "doc_id")
    assert index.tiles == 8 and index.postings.count() == 7 * 8
    assert index.vocabulary.agg({"documents": "sum"}).first()[0] == 10_000
