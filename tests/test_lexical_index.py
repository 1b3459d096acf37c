from __future__ import annotations

import random

import pytest

from ledgerspark.plans import lexical_index, search

WORDS = ["coffee", "coffeehouse", "latte", "market", "uber", "hotel", "café", "x", "tv", "hotelier", "the", "ΑΒΓ", "a-b", "é", "1st", "10", "210"]


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(4)
    weights = [1 / (n + 1) for n in range(len(WORDS))]
    docs = [(n, " ".join(draw.choices(WORDS, weights, k=draw.choice([1, 4, 30]))), f"kind{n % 3}") for n in range(600)]
    docs += [(1000, ""), (1001, None), (1002, "ééé ΑΒΓ"), (1003, "Streaming, hotel-market; COFFEE hotel")]
    docs = [(*row, "kind0") if len(row) == 2 else row for row in docs]
    asked = [(n, " ".join(draw.choices(WORDS, k=draw.choice([1, 2, 5])))) for n in range(40)]
    asked += [(100, " Coffee "), (101, "travel hotel"), (102, "ab"), (103, "ééé"), (104, "ΑΒΓ"), (105, "zzz"), (106, "tv t"),
              (107, "the the the"), (108, "hotel market"), (109, "offee"), (110, ""), (111, "streaming services")]
    queries = spark.createDataFrame([(*row, None) for row in asked], "query_id long, query_text string, embedding array<float>")
    return queries, spark.createDataFrame(docs, "doc_id long, text string, kind string").repartition(3)


def rows(frame):
    return sorted((r["query_id"], r["doc_id"], round(r["lexical_score"], 9)) for r in frame.collect())


def test_index_equals_the_full_scan(made):
    queries, docs = made
    index = lexical_index.build_lexical_index(docs, "text", "doc_id")
    found = lexical_index.indexed_search(queries, index)
    full = search.lexical_search(queries, docs, "text")
    assert set(found.columns) == set(full.columns)
    assert rows(found) == rows(full) and len(rows(full)) > 3000


@pytest.mark.parametrize("k", [1, 7, 60])
def test_top_k_equals_the_full_scan(made, monkeypatch, k):
    monkeypatch.setattr(lexical_index, "FIRST_LOOK", 2)
    queries, docs = made
    index = lexical_index.build_lexical_index(docs, "text", "doc_id")
    best = {}
    for query, doc, score in rows(search.lexical_search(queries, docs, "text")):
        best.setdefault(query, []).append((-score, doc))
    found = lexical_index.indexed_top_k(queries, index, k).collect()
    got = sorted((r["query_id"], r["rank"], r["doc_id"], round(-r["lexical_score"], 9)) for r in found)
    assert got == sorted((q, n, doc, score) for q, held in best.items() for n, (score, doc) in enumerate(sorted(held)[:k], 1))


def test_join_rows_grow_with_matches(spark):
    """Ten times the documents without a match bring no further row to the joins."""
    queries = spark.createDataFrame([(n, f"word{n}", None) for n in range(50)], "query_id long, query_text string, embedding array<float>")
    matching = [(n, f"some word{n} here") for n in range(50)]

    def joined(others):
        docs = spark.createDataFrame(matching + [(100 + n, f"filler text {n * 7} again") for n in range(others)], "doc_id long, text string")
        index = lexical_index.build_lexical_index(docs, "text", "doc_id")
        matched = lexical_index.matched_units(queries, index)
        assert len(rows(lexical_index.indexed_search(queries, index))) == 50 + 40  # word1 is part of word10, and so on
        return matched.count(), lexical_index.unit_scores(matched, index).count()

    assert joined(200) == joined(2000)


def test_empty_tables(made):
    queries, docs = made
    index = lexical_index.build_lexical_index(docs.limit(0), "text", "doc_id")
    assert rows(lexical_index.indexed_search(queries, index)) == [] == lexical_index.indexed_top_k(queries, index).collect()
    index = lexical_index.build_lexical_index(docs, "text", "doc_id")
    assert rows(lexical_index.indexed_search(queries.limit(0), index)) == []


def test_no_products_in_the_plan(made):
    queries, docs = made
    index = lexical_index.build_lexical_index(docs, "text", "doc_id")
    for frame in (lexical_index.indexed_search(queries, index), lexical_index.indexed_top_k(queries, index)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_shared_units_are_looked_up_once(spark, made):
    """Ten times the queries with the same words bring no further row to the look-ups, and no such table is broadcast."""
    index = lexical_index.build_lexical_index(made[1], "text", "doc_id")

    def matched(count):
        asked = [(n, "coffee hotel market", None) for n in range(count)]
        return lexical_index.matched_units(spark.createDataFrame(asked, "query_id long, query_text string, embedding array<float>"), index)

    assert matched(3).count() == matched(30).count() > 0
    plan = lexical_index.unit_scores(matched(3), index)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
