"""Every operator on odd rows and on empty tables: one result a row, defined values, no crash."""

from __future__ import annotations

import public_tokenizers
import pytest

from ledgerspark.llm import bpe_counts, hamming, katz, merge_encoding, ngram_rules, packing, ranking, severity, sketch, skip_chain

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

OPERATORS = {
    "severity": lambda docs, labels: severity.score(docs, severity.train(docs, labels)),
    "packing": lambda docs, labels: packing.packed_documents(docs, BYTES),
    "ranking": lambda docs, labels: ranking.score(docs, ranking.train(docs, labels)),
    "hamming": lambda docs, labels: hamming.near_duplicates(docs),
    "skip_chain": lambda docs, labels: skip_chain.found_spans(docs, skip_chain.train(docs)),
    "katz": lambda docs, labels: katz.score(docs),
    "merge_encoding": lambda docs, labels: merge_encoding.encode_decode(docs, PIECES),
    "bpe_counts": lambda docs, labels: bpe_counts.token_counts(docs, BYTES),
    "ngram_rules": lambda docs, labels: ngram_rules.quality_rules(docs, labels),
    "sketch": lambda docs, labels: sketch.compare_with_edits(docs),
}


@pytest.fixture(scope="module")
def results(odd, odd_labels):
    return {name: operator(odd, odd_labels).collect() for name, operator in OPERATORS.items()}


@pytest.mark.parametrize("name", [name for name in OPERATORS if name != "packing"])
def test_one_result_a_row(results, name):
    ids = sorted((row.doc_id for row in results[name]), key=lambda i: (i is None, i))
    assert ids == [1, 2, 3, 4, 5, 5, 6, 7, 8, None, None]


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_agree(results, name):
    places = ("sequence_id", "offset", "near_next", "edited_sha256", "edited_fingerprint", "near_edited")
    same = {tuple(v for k, v in row.asDict().items() if k not in places) for row in results[name] if row.doc_id == 5}
    assert len(same) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, odd, odd_labels, name):
    assert OPERATORS[name](odd.limit(0), odd_labels.limit(0)).collect() == []
    assert len(OPERATORS[name](odd.where("doc_id <= 5"), odd_labels.limit(0)).collect()) == 6


def by_id(results, name):
    return {row.doc_id: row for row in results[name]}


def test_texts_without_words(results):
    assert [by_id(results, "bpe_counts")[i].n_tokens for i in (1, 2)] == [0, 0]
    assert [by_id(results, "merge_encoding")[i].n_tokens for i in (1, 2)] == [0, 0]
    assert {by_id(results, "hamming")[i].fingerprint for i in (1, 2, 3)} == {"0" * 16}
    assert {by_id(results, "hamming")[i].component_id for i in (1, 2, 3)} == {1}
    assert [by_id(results, "katz")[i].n_tokens for i in (1, 2, 3)] == [1, 1, 1]
    assert [by_id(results, "ngram_rules")[i].llr for i in (1, 2, 3)] == [0.0, 0.0, 0.0]
    assert [by_id(results, "sketch")[i].near_next for i in (1, 5)] == [1.0, 1.0]


def test_long_text(results):
    assert by_id(results, "ngram_rules")[8].n_words == 30_000
    assert by_id(results, "katz")[8].n_tokens == 30_001
    assert by_id(results, "bpe_counts")[8].over_limit


def test_filters_keep_all_columns(odd, odd_labels):
    for kept in (
        ranking.accepted(odd, None),
        ngram_rules.kept_documents(odd, odd_labels),
        hamming.one_of_each_group(odd),
        skip_chain.masked(odd, skip_chain.train(odd)),
    ):
        assert kept.columns == odd.columns
        kept.collect()


def test_one_of_each_group_stays(odd):
    kept = [(row.doc_id, row.text) for row in hamming.one_of_each_group(odd).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 4, 5, 7, 8]
    assert [text for i, text in kept if i is None] == ["a row without an id"]


def test_models_without_labels(odd):
    assert {row.score for row in ranking.score(odd, None).collect()} == {0.5}
    assert {row.expected_severity for row in severity.score(odd, None).collect()} == {0.0}


def test_ids_that_are_no_numbers(spark):
    """Operator 10 orders documents by number; text ids that are numbers are taken as such, and others are an error."""
    numbers = spark.createDataFrame([("10", "a b c"), ("9", "d e f")], "doc_id string, text string")
    rows = {row.doc_id: row for row in sketch.compare_with_edits(numbers).collect()}
    assert set(rows) == {"9", "10"} and rows["9"].n_chars == 5
    names = spark.createDataFrame([("x", "a b c"), ("y", "d e f")], "doc_id string, text string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sketch.compare_with_edits(names).collect()
