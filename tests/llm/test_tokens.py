"""Token counts, ids, pieces and packing against the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerspark.llm import bpe_counts, merge_encoding, packing

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(count: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    alphabet = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "😀", "▁", "中文", "0", "12", "'s", "'ll", ".", "!!", "\x00", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<s>", "<0x41>"]
    return ["".join(draw.choices(alphabet, k=draw.randint(0, 25))) for _ in range(count)] + ["a" * 500, " " * 70, "ab" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_equal_the_library(library, texts):
    counter = bpe_counts.MergeCounter(BYTES)
    for text in [*odd_texts(1500, 1), *texts.values()]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_ids_equal_the_library(library, texts):
    encoder = packing.ByteEncoder(BYTES)
    for text in [*odd_texts(1500, 2), *texts.values()]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_encoding_and_decoding_equal_the_library(pieces, texts):
    vocabulary = merge_encoding.PieceVocabulary(PIECES)
    for text in [*odd_texts(3000, 3), *texts.values()]:
        ids = pieces.encode(text)
        assert vocabulary.encode(text) == ids, text[:80]
        assert vocabulary.decode(ids) == pieces.decode(ids)


def test_decoding_any_ids(pieces):
    vocabulary, draw = merge_encoding.PieceVocabulary(PIECES), random.Random(4)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(3)]) for _ in range(draw.randint(0, 9))]
        assert vocabulary.decode(ids) == pieces.decode(ids), ids


def test_digests_and_round_trip(documents, texts, pieces):
    for row in merge_encoding.encode_decode(documents, PIECES).collect():
        ids = pieces.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
    decoded = merge_encoding.decode_ids(merge_encoding.encode_ids(documents, PIECES), PIECES)
    assert {row.doc_id: row.text for row in decoded.collect()} == texts


def test_packing_whole_documents(documents, texts, library):
    rows = packing.packed_documents(documents, BYTES).collect()
    sequences: dict[int, list] = {}
    lengths: dict[int, int] = {}
    for row in rows:
        ids = np.array([*library.encode(texts[row.doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())
        assert len(ids) <= 1024 or row.piece == 0 or row.length == 1024
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
        lengths[row.doc_id] = lengths.get(row.doc_id, 0) + row.length
        assert row.start + row.length <= len(ids)
        if row.start + row.length == len(ids):
            lengths[row.doc_id] -= len(ids)
    assert set(lengths) == set(texts) and not any(lengths.values())
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= 1.02 * sum(row.length for row in rows) / 1024 + 1


def replayed(histogram: dict[int, int], plan: packing.Plan) -> dict[int, list[tuple[int, int]]]:
    bins: dict[int, list[tuple[int, int]]] = {}
    for length, count in histogram.items():
        sequence, offset = plan.place(np.full(count, length), np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            bins.setdefault(s, []).append((o, length))
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, 64, 4096), (64, 3, 4096), (64, 64, 4500), (64, 2, 4200)])
def test_every_capacity_holds(rule, limits):
    draw = random.Random(hash(limits) % 1000)
    histogram = {draw.randint(1, 64): draw.randint(1, 40) for _ in range(40)}
    tokens, documents, attention = limits
    plan = packing.plan_bins(histogram, tokens, documents, attention, rule=rule)
    bins = replayed(histogram, plan)
    assert set(bins) == set(range(plan.sequences))
    for parts in bins.values():
        lengths = [length for _, length in parts]
        assert sum(lengths) <= tokens and len(parts) <= documents and sum(n * n for n in lengths) <= attention
        assert sorted(parts)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))


def test_a_piece_that_cannot_fit_is_an_error():
    with pytest.raises(ValueError):
        packing.plan_bins({10: 1}, 64, 64, 99)


def test_recent_cache_keeps_what_is_asked_for():
    from ledgerspark.llm.common import RecentCache

    made = []
    cache = RecentCache(lambda key: made.append(key) or key * 2, 3)
    for key in [1, 2, 3, 1, 4, 1, 5, 6, 1, 7, 8, 1]:
        assert cache[key] == key * 2 and len(cache) <= 3 and len(cache.older) <= 3
    assert made == [1, 2, 3, 4, 5, 6, 7, 8]
