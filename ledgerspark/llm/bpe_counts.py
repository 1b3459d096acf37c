"""Operator 8: token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens. The bytes of a pre-token are the symbols of a linked list; a heap holds its adjacent
pairs by merge rank. The lowest pair is popped again and again, stale entries are skipped, and the count is the
initial symbols minus the merges made. No token id is ever built.

Defined results: null and empty texts have no tokens; repeated rows are counted each; an empty table gives an empty
result; only the id and text columns are read, whatever else the table holds.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import islice

import regex
from pyspark.sql import DataFrame

from .common import BoundedCache, arrow_rows, fields, units

#: The split before merging that the vocabulary's byte-level pre-tokenizer makes.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, mapped back to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeCounter:
    """Counts tokens of a byte-level merge vocabulary stored as JSON."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [token["content"] for token in spec.get("added_tokens", [])]
        symbols = byte_symbols()
        self.initial = [0] * 256
        for character, byte in symbols.items():
            self.initial[byte] = vocabulary[character]
        # The rank of a pair of symbols, and the symbol each rank makes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocabulary[left], vocabulary[right]), rank)
            self.made.append(vocabulary[left + right])
        self.pieces = regex.compile(BYTE_LEVEL_SPLIT)
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.piece_count = BoundedCache(self.merged_count)
        self.after_space = BoundedCache(lambda unit: self.unit_count(" " + unit))

    def merged_count(self, piece: str) -> int:
        initial = self.initial
        symbols = [initial[byte] for byte in piece.encode()]
        size = len(symbols)
        rank_of = self.ranks.get
        # A heap entry is rank * size + place, so the lowest rank comes first and, among equals, the leftmost place.
        heap = [
            rank * size + at
            for at, rank in enumerate(map(rank_of, zip(symbols, islice(symbols, 1, None))))
            if rank is not None
        ]
        if not heap:
            return size
        heapq.heapify(heap)
        pop, push, made = heapq.heappop, heapq.heappush, self.made
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merges = 0
        while heap:
            rank, at = divmod(pop(heap), size)
            right = after[at]
            if right >= size or symbols[at] < 0 or rank_of((symbols[at], symbols[right])) != rank:
                continue
            merges += 1
            merged = symbols[at] = made[rank]
            symbols[right] = -1
            following = after[at] = after[right]
            if following < size:
                before[following] = at
                found = rank_of((merged, symbols[following]))
                if found is not None:
                    push(heap, found * size + at)
            leading = before[at]
            if leading >= 0:
                found = rank_of((symbols[leading], merged))
                if found is not None:
                    push(heap, found * size + leading)
        return size - merges

    def plain_count(self, text: str) -> int:
        return sum(map(self.piece_count.__getitem__, self.pieces.findall(text)))

    def unit_count(self, unit: str) -> int:
        if self.cuts is None or not self.cuts.search(unit):
            return self.plain_count(unit)
        return len(self.cuts.findall(unit)) + sum(map(self.plain_count, self.cuts.split(unit)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = units(text)
        return self.unit_count(parts[0]) + sum(map(self.after_space.__getitem__, islice(parts, 1, None)))


@lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    """One counter per worker process and vocabulary."""
    return MergeCounter(path)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Bytes and tokens of each whole text, and whether it has more than ``limit`` tokens. Narrow: no shuffle."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        counts = counter(tokenizer)
        tokens = [counts.count(text) for text in rows["text"]]
        return {
            "doc_id": rows["doc_id"],
            "n_bytes": [len(text.encode()) if text else 0 for text in rows["text"]],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    kind = documents.schema[id_column].dataType.simpleString()
    return arrow_rows(
        fields(documents, doc_id=id_column, text=text_column),
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
        work,
    )
