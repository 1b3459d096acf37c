"""Operator 5: numbers written in groups carry their labels to other spellings."""

from __future__ import annotations

import time

import pytest

from ledgerspark.llm import skip_chain


@pytest.fixture(scope="module")
def field(documents):
    return skip_chain.train(documents)


@pytest.mark.parametrize(
    ("text", "added"),
    [
        ("Call +1 297 555 8151 now, or later 297 555 8151 again.", ["297 555 8151"]),
        ("Card 4035 5010 0000 0008 is written 4035.5010.0000.0008 there.", ["4035.5010.0000.0008"]),
        ("Call +1 (297) 555-8151 now, or later 297 555 8151 again.", ["297 555 8151"]),
        ("Call 297 555 8151 now, or +1-297-555-8151 later.", ["297 555 8151"]),
        ("Card 4035501000000008 is written 4035  5010  0000  0008 there.", ["4035  5010  0000  0008"]),
        ("Call +1 297 555 8151 now. Then 297 555 8151 12 times.", None),
    ],
)
def test_groups_are_linked(field, text, added):
    base, spans = field.spans(text)
    assert set(base) < set(spans)
    found = [text[start:end] for kind, start, end in spans if (kind, start, end) not in base]
    assert "8151" not in skip_chain.mask_text(text, spans) and "0008" not in skip_chain.mask_text(text, spans)
    assert "297" not in skip_chain.mask_text(text, spans) and "4035" not in skip_chain.mask_text(text, spans)
    assert added is None or found == added


def test_other_numbers_stay(field):
    for text in (
        "Call +1 297 555 8151 now, or 297 555 8152 and 129 7555 too.",
        "Card 4035 5010 0000 0008 and 12 3456 0000 0009 units.",
        "Call +1 297 555 8151 in 2024 or 8151 others, 555 of them.",
    ):
        base, spans = field.spans(text)
        assert base and base == spans, text


def test_long_tables_of_numbers_take_linear_time():
    for text in ("1 " * 40_000, "12 345 6789 " * 15_000):
        began = time.time()
        tokens = skip_chain.Tokens("+1 297 555 8151 x " + text, skip_chain.pattern_spans("+1 297 555 8151 x"))
        assert len(tokens.links) <= 2 * skip_chain.MOST_DIGITS * len(tokens.texts)
        assert time.time() - began < 30
