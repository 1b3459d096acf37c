"""Small documents that every operator must handle: nulls, empty and long texts, repeated rows, clashing names."""

from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"
CLASHING = "length long, rank long, block long, label string, kind string, words string, ratio long, root long, n long, id long"


def odd_rows():
    words = "the quick brown fox jumps over the lazy dog while seven wizards calmly quote plain verse in turn".split()
    long_text = " ".join(words[(i * 7 + i // 9) % len(words)] + str(i % 97) for i in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "One"),
        (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
        (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
        (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
        (7, "call +1 (297) 555-8151 or (297) 555-8151, mail a.b@c.example, at 10.0.0.1 <|endoftext|> é😀▁x"),
        (8, long_text),
        (None, "a row without an id"),
        (None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names the operators use inside."""
    extra = (0, 0, 0, "x", "x", "x", 0, 0, 0, 0)
    rows = [(i, text, "en", "s", len(text or ""), *extra) for i, text in odd_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(4, 0, 0, 1), (5, 1, 1, 2), (5, None, None, 3), (6, 1, 0, 4), (None, 1, 1, 5), (99, 0, 1, 6), (8, 0, 0, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text long")


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("the given tables are not here")
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {row.doc_id: row.text for row in documents.select("doc_id", "text").collect()}
