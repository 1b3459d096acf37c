"""Operator 11 against a plain scoring of every pair."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from ledgerspark.llm import norm_buckets

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(documents, items, k):
    """Rows (item_id, rank, doc_id, score) by the formula, pair by pair."""
    found = [(doc, Counter(plain_terms(text))) for doc, text in documents]
    docs, words = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    df = Counter(term for _, c in found for term in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, counts in found:
            length = 100 - 50 + 50 * counts.total() * docs // words if words else 0
            score = 0
            for term in set(plain_terms(text)) & set(counts):
                weight = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[term] + 1)))
                score += weight * (1_000_000_000 * counts[term] // (1000 * counts[term] + 20 * length))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, unknown, doc) in enumerate(sorted(scored)[:k], 1):
            rows.append((item, rank, None if unknown else doc, -score))
    return rows


def rows_of(result):
    return [tuple(row) for row in result.select("item_id", "rank", "doc_id", "score").collect()]


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((value is None, value or 0) for value in row))


@pytest.fixture(scope="module")
def made():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ß1", "x-y", "A.b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    documents = [(i, " ".join(draw.choices(words, weights, k=draw.choice([3, 20, 80, 400])))) for i in range(900)]
    documents += [(900 + i, documents[7][1]) for i in range(120)] + [(None, documents[8][1]), (None, None), (2000, ""), (2001, "!?")]
    documents += [(7, documents[7][1]), (7, documents[7][1])]
    items = [(i, " ".join(draw.choices(words, weights, k=draw.choice([1, 6, 40])))) for i in range(30)]
    items += [(30, documents[7][1]), (30, documents[7][1]), (31, None), (32, ""), (None, "W3 w4"), (33, "unheard of")]
    return documents, items


@pytest.mark.parametrize("bucket, terms", [(2048, 100_000), (16, 50)])
def test_equals_plain_scoring(spark, made, monkeypatch, bucket, terms):
    monkeypatch.setattr(norm_buckets, "BUCKET", bucket)
    documents, items = made
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(norm_buckets.item_blocks, "__defaults__", (terms,))
    assert ordered(rows_of(norm_buckets.search(docs, asked, 10))) == ordered(plain_search(documents, items, 10))


def test_few_matches_and_text_ids(spark):
    documents = [("b", "red green"), ("a", "red green"), ("c", "blue"), (None, "red red red")]
    docs = spark.createDataFrame(documents, "doc_id string, text string")
    items = spark.createDataFrame([("q", "Red blue"), ("r", "pink")], "item_id string, text string")
    rows = rows_of(norm_buckets.search(docs, items))
    assert sorted(row[1] for row in rows) == [1, 2, 3, 4]
    by_rank = {row[1]: row for row in rows}
    same = [row for row in rows if row[2] in ("a", "b")]
    assert same[0][3] == same[1][3] and abs(same[0][1] - same[1][1]) == 1
    assert min(same, key=lambda row: row[1])[2] == "a" and by_rank[1][2] == "c"


def test_odd_rows_and_empty_tables(spark, odd):
    asked = odd.select("doc_id", "text", "label").withColumnRenamed("doc_id", "item_id")
    rows = rows_of(norm_buckets.search(odd, asked))
    pairs = [(row.doc_id, row.text) for row in odd.select("doc_id", "text").collect()]
    assert ordered(rows) == ordered(plain_search(pairs, pairs, 50))
    assert rows_of(norm_buckets.search(odd.limit(0), asked)) == []
    assert rows_of(norm_buckets.search(odd.where("doc_id < 4"), asked)) == []
    assert rows_of(norm_buckets.search(odd, asked.limit(0))) == []


def test_bounds_prune_and_lose_nothing(spark):
    """Short documents cannot reach what long ones reach, so most are never scored."""
    import numpy as np

    draw = np.random.default_rng(3)
    lengths = np.sort(draw.integers(1, 40, 500))[::-1]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    terms = np.concatenate([np.sort(draw.choice(200, n, replace=False)) for n in lengths])
    impacts = draw.integers(1, 1000, len(terms))
    weights = draw.integers(1, 5000, 200)
    norms = np.sqrt(np.add.reduceat(weights[terms] * impacts.astype(float) ** 2, offsets[:-1]))
    order = np.argsort(-norms)
    rows = [slice(offsets[i], offsets[i + 1]) for i in order]
    sizes = lengths[order]
    bucket = norm_buckets.Bucket(
        norms[order],
        np.concatenate([[0], np.cumsum(sizes)]),
        np.concatenate([terms[r] for r in rows]),
        np.concatenate([impacts[r] for r in rows]),
        weights,
    )
    query = norm_buckets.query_of(draw.choice(200, 12, replace=False), weights)
    asked = np.zeros(200, np.int64)
    asked[query.terms] = 1
    scores = bucket.scores(np.arange(500), asked)
    for place in (1, 10, 50):
        least = int(np.sort(scores)[-place])
        kept = bucket.survivors(query, least)
        assert set(np.flatnonzero(scores >= least)) <= set(kept)
        assert len(kept) < 400
