from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest

from ledgerspark.plans import enrichment, search
from ledgerspark.schemas import EMBEDDING_CACHE, ENRICHMENT_CACHE, PROFILE_CACHE
from ledgerspark.testbed import letter_counts
from tests.frames import day, small_fact

NOW = dt.datetime(2024, 1, 1)
DOCS = "transaction_id string, transaction_date date, search_text string, embedding array<float>"


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query_text string, embedding array<float>")


def python_scores(text, vector, query, terms, query_vector):
    text = text.lower()
    tokens = set("".join(c if c.isascii() and c.isalnum() else " " for c in text).split())
    lexical = 3.0 if query in text else 0.0
    for term in terms:
        if " " in term:
            lexical += 1.5 if term in text else 0
        else:
            lexical += 1.0 if term in tokens else (0.5 if term in text else 0)
    norms = math.sqrt(sum(x * x for x in vector)) * math.sqrt(sum(x * x for x in query_vector))
    semantic = sum(a * b for a, b in zip(vector, query_vector, strict=False)) / norms if norms else 0.0
    return semantic, lexical


def test_search_equals_scoring_every_pair(spark):
    random.seed(2)
    words = ["coffee", "latte", "market", "uber", "hotel", "café", "coffeehouse", "x"]
    docs = [
        (f"t{n:04d}", day(n % 17), " ".join(random.choices(words, k=4)),
         [float(random.choice([-1, 0, 1])) for _ in range(4)])
        for n in range(700)
    ]
    asked = [(1, " Coffee ", [1.0, 0.0, 0.0, 1.0]), (2, "travel hotel", [0.0, 1.0, 0.0, 0.0]), (3, "ab", [1.0])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = search.hybrid_search(
            queries(spark, asked), spark.createDataFrame(docs, DOCS), result_limit=5, candidate_count=12
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expanded = {r["query_id"]: r for r in search.expand_query(search.query_guard(queries(spark, asked))).collect()}
    assert set(expanded) == {1, 2}
    for number, query in expanded.items():
        ranked = []
        for key, date, text, vector in docs:
            semantic, lexical = python_scores(
                text, vector, query["query_text"].lower(), query["terms"], dict((a, v) for a, _, v in asked)[number])
            ranked.append((-(round(semantic + 0.08 * lexical, 9)), -round(semantic, 9), -date.toordinal(), key))
        expected = [key for *_, key in sorted(ranked)[:12]]
        got = sorted((r for r in found if r["query_id"] == number), key=lambda r: r["candidate_index"])
        assert [r["transaction_id"] for r in got] == expected


def test_hundreds_of_queries_stay_a_table(spark):
    docs = spark.createDataFrame([("a", day(0), "coffee", [1.0]), ("b", day(1), "hotel", [0.0])], DOCS)
    asked = queries(spark, [(n, "coffee" if n % 2 else "hotel bar", [1.0]) for n in range(300)] + [(7, "coffee", [1.0])])
    found = search.hybrid_search(asked, docs).collect()
    assert sorted({r["query_id"] for r in found}) == list(range(300)) and len(found) == 602
    plan = search.hybrid_search(asked, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_lexical_search_returns_matches_only(spark):
    docs = spark.createDataFrame([(1, "coffee bar"), (2, "hotel"), (3, None)], "doc_id long, text string")
    found = search.lexical_search(queries(spark, [(1, "coffee", None), (2, "zebra", None)]), docs, "text").collect()
    assert [(r["query_id"], r["doc_id"]) for r in found] == [(1, 1)]


def test_cosines_of_missing_zero_and_uneven_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [3.0]), ("e", [1.0, 2.0, 2.0])]
    docs = spark.createDataFrame([(key, day(0), "coffee", vector) for key, vector in rows], DOCS)
    asked = queries(spark, [(1, "coffee", [1.0, 0.0]), (2, "coffee", None)])
    got = {(r["query_id"], r["transaction_id"]): round(r["semantic_score"], 6) for r in search.score_documents(asked, docs).collect()}
    assert [got[1, key] for key in "abcde"] == [1.0, 0.0, 0.0, 1.0, 0.333333]
    assert {got[2, key] for key in "abcde"} == {0.0}


def candidates(spark):
    rows = [(1, n, f"t{n}", 0.5 - n / 10, float(n % 3), 0.5) for n in range(5)]
    rows += [(2, n, f"u{n}", 0.1, 0.0, 0.1) for n in range(2)]
    schema = ("query_id long, candidate_index int, transaction_id string, semantic_score double, lexical_score double, "
              "hybrid_score double")
    return spark.createDataFrame(rows, schema)


def test_results_without_rerank_scores_keep_hybrid_order(spark):
    none = spark.createDataFrame([], "query_id long, candidate_index int, rerank_score double")
    got = search.rerank_and_gate(candidates(spark), none).orderBy("query_id", "rank").collect()
    assert [r["transaction_id"] for r in got] == ["t0", "t1", "t2"]
    assert {r["rank_source"] for r in got} == {"hybrid_semantic"}


def test_reranked_results(spark):
    scores = spark.createDataFrame([(1, 4, 0.9), (1, 0, 0.2)], "query_id long, candidate_index int, rerank_score double")
    got = search.rerank_and_gate(candidates(spark), scores, k=3).orderBy("rank").collect()
    assert [(r["rank"], r["transaction_id"], r["match_confidence"]) for r in got] == [
        (1, "t4", "high"), (2, "t0", "high"), (3, "t1", "high")]
    assert {r["rank_source"] for r in got} == {"cohere_rerank"}


def test_backfill_embeds_only_new_and_changed_texts(spark):
    fact = small_fact(spark)
    profiles = spark.createDataFrame(
        [("Beta", "Group", "Home", "Sells homes", ["shopping"], "", "m", NOW)], PROFILE_CACHE)
    docs = search.build_search_documents(fact, search.profile_lookup(profiles, "m"))
    texts = {r["transaction_id"]: r["search_text"] for r in docs.collect()}
    assert texts["t0003"].endswith("merchant_source: seed_rule. merchant_summary: Sells homes. semantic_tags: shopping.")
    assert texts["t0001"].endswith("merchant_source: fallback. ")
    cache = spark.createDataFrame(
        [("t0001", "m", texts["t0001"], [9.0], NOW), ("t0002", "m", "old text", [8.0], NOW),
         ("gone", "m", "kept", [7.0], NOW), ("t0003", "other", texts["t0003"], [6.0], NOW)], EMBEDDING_CACHE)
    seen = spark.sparkContext.accumulator(0)

    def embed(batch):
        seen.add(len(batch))
        assert len(batch) <= 3
        return letter_counts(batch)

    filled = {(r["transaction_id"], r["embedding_model"]): r["embedding"]
              for r in search.embedding_backfill(docs, cache, embed, "m", batch=3).collect()}
    assert seen.value == 7
    assert filled[("t0001", "m")] == [9.0] and filled[("gone", "m")] == [7.0] and filled[("t0003", "other")] == [6.0]
    assert filled[("t0002", "m")] == letter_counts([texts["t0002"]])[0]
    assert len(filled) == 10


def test_newest_transactions_for_a_bounded_backfill(spark):
    newest = search.newest_first(small_fact(spark), 2).collect()
    assert [r["transaction_id"] for r in newest] == ["t0008", "t0007"]


def replies(spark, rows):
    frame = spark.createDataFrame(rows, "raw_description string, reply string")
    return frame.selectExpr("*", "'m' as model", "timestamp '2024-01-01' as created_at")


def test_replies_are_validated_with_defaults(spark):
    asked = spark.createDataFrame([(t, "Home") for t in "abcdef"] + [("g", None)],
                                  "raw_description string, raw_category string")
    rows = [
        ("a", 'ok {"suggested_merchant": "A", "suggested_category": "Travel", "confidence": 0.9}'),
        ("b", '{"suggested_category": "Nonsense", "confidence": "0.5"}'),
        ("c", "no object"),
        ("d", '{"suggested_merchant": "D", '),
        ("e", '{"confidence": "very"}'),
        ("f", "{}"),
        ("g", '{"confidence": null}'),
        ("stranger", '{"suggested_merchant": "S"}'),
    ]
    got = {r["raw_description"]: r for r in enrichment.validate_enrichment(replies(spark, rows), asked).collect()}
    assert sorted(got) == ["a", "b", "f", "g"]
    assert (got["a"]["suggested_merchant"], got["a"]["suggested_category"], got["a"]["confidence"]) == ("A", "Travel", 0.9)
    assert (got["b"]["suggested_merchant"], got["b"]["suggested_category"], got["b"]["confidence"]) == ("b", "Other", 0.5)
    assert (got["f"]["suggested_category"], got["f"]["suggested_merchant_group"]) == ("Home", "AI Suggested")
    assert (got["g"]["suggested_category"], got["g"]["confidence"]) == ("Other", 0.0)
    rejected = enrichment.rejected_replies(replies(spark, rows), asked).collect()
    assert sorted(r["raw_description"] for r in rejected) == ["c", "d", "e"]


def test_enrichment_cycle_leaves_known_rows_alone(spark):
    review = spark.createDataFrame(
        [("a", "Home", 5, 10.0, 110.0, True), ("b", "Home", 5, 10.0, 120.0, True), ("c", None, 1, 1.0, 5.0, False)],
        "raw_description string, raw_category string, transaction_count int, total_spend double, "
        "review_priority_score double, needs_review boolean")
    cache = spark.createDataFrame([("b", "Old", "Home", "G", 0.9, "", "m", NOW)], ENRICHMENT_CACHE)
    rows = replies(spark, [(t, '{"suggested_merchant": "New", "confidence": 0.8}') for t in "abc"])
    got = {r["raw_description"]: r["suggested_merchant"]
           for r in enrichment.enrichment_cycle(review, cache, rows).collect()}
    assert got == {"a": "New", "b": "Old"}


def test_last_profile_reply_wins_and_strangers_are_ignored(spark):
    batch = spark.createDataFrame([("Beta", "G", "Home")],
                                  "normalized_merchant string, merchant_group string, final_category string")
    rows = [
        (1, '{"profiles": [{"normalized_merchant": "Beta", "merchant_summary": "first"}, '
            '{"normalized_merchant": "Nobody"}]}'),
        (2, 'text {"profiles": [{"normalized_merchant": " Beta ", "merchant_summary": " second ", '
            '"semantic_tags": ["Bar"]}]}'),
        (3, '{"profiles": null}'),
    ]
    got = enrichment.profile_batch_match(spark.createDataFrame(rows, "reply_id long, reply string"), batch).collect()
    assert [(r["normalized_merchant"], r["merchant_summary"], r["semantic_tags"]) for r in got] == [
        ("Beta", "second", ["bar"])]


@pytest.mark.parametrize(("text", "kept"), [(" ab ", False), ("abc", True), ("   ", False), (None, False)])
def test_short_queries_are_rejected(spark, text, kept):
    frame = search.query_guard(queries(spark, [(1, text, None)]))
    assert frame.count() == int(kept)
