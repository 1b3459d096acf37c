"""Operator 7: exact merge-type encoding by backtracking, and decoding, for sentence-piece merge vocabularies.

Instead of merging, a word is covered from the left. An Aho-Corasick pass gives the longest piece that starts at
each place. The next piece is accepted if it is compatible with the one before it, that is, if merging the two
texts again gives just these two pieces; otherwise a shorter piece that starts there is tried, and when none is left the place is
marked as failed in a bitfield and the piece before it is shortened. A sequence whose neighbours are all compatible
is the result of merging.

No piece of such a vocabulary has a space mark after another character, so words are encoded one by one and
remembered. Runs of space marks, whose pieces may share one score, are merged directly.

Defined results: null and empty texts have no ids and decode to empty text; repeated rows are encoded each; an empty
table gives an empty result; only the id and text columns are read, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .common import BoundedCache, RecentCache, arrow_rows, fields

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "


class PieceVocabulary:
    """Pieces, scores and kinds read from a model file; encodes and decodes without the library's own encoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.piece = [model.id_to_piece(i) for i in ids]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in ids if model.is_byte(i)}
        self.byte_id = {byte: i for i, byte in self.byte_of.items()}
        self.control = {i for i in ids if model.is_control(i)}
        self.unknown = model.unk_id()
        normal = [i for i in ids if i not in self.byte_of and i not in self.control and i != self.unknown]
        self.id_of = {self.piece[i]: i for i in normal}
        self.plain_surface = [p.replace(SPACE, " ") if p in self.id_of else None for p in self.piece]
        order = {score: rank for rank, score in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        self.rank = {self.piece[i]: order[model.get_score(i)] for i in normal if len(self.piece[i]) > 1}
        crossing = [p for p in self.id_of if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE))]
        if crossing or len(self.byte_id) != 256 or any(c not in self.id_of for p in self.rank for c in p):
            raise ValueError("not a merge vocabulary with byte fallback whose pieces stay within words")
        self.known = {p for p in self.id_of if len(p) == 1}
        self.matches = ahocorasick.Automaton()
        for piece in self.id_of:
            if not piece.startswith(SPACE * 2) and self.merged(piece) == [piece]:
                self.matches.add_word(piece, (len(piece) - 1, piece))
        self.matches.make_automaton()
        # For each piece, the longest shorter piece that is a prefix of it.
        self.shorter = {}
        for piece in self.matches.keys():
            lengths = range(len(piece) - 1, 0, -1)
            self.shorter[piece] = next((piece[:n] for n in lengths if self.matches.exists(piece[:n])), None)
        self.compatible = BoundedCache(lambda pair: self.merged(pair[0] + pair[1]) == [pair[0], pair[1]])
        self.words = RecentCache(lambda word: self.described(" " + word), 300_000)

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging the best-ranked adjacent pair, the leftmost first."""
        symbols: list[str] = list(text)
        size, rank_of = len(symbols), self.rank.get
        heap = []
        for at in range(size - 1):
            pair = symbols[at] + symbols[at + 1]
            if (rank := rank_of(pair)) is not None:
                heap.append((rank, at, pair))
        heapq.heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            _, at, pair = heapq.heappop(heap)
            right = after[at]
            if not symbols[at] or right >= size or len(symbols[at]) + len(symbols[right]) != len(pair):
                continue
            symbols[at], symbols[right] = pair, ""
            following = after[at] = after[right]
            if following < size:
                before[following] = at
                if (rank := rank_of(pair + symbols[following])) is not None:
                    heapq.heappush(heap, (rank, at, pair + symbols[following]))
            if (leading := before[at]) >= 0 and (rank := rank_of(symbols[leading] + pair)) is not None:
                heapq.heappush(heap, (rank, leading, symbols[leading] + pair))
        return [symbol for symbol in symbols if symbol]

    def covered(self, text: str) -> list[str]:
        """Pieces of ``text``, whose characters are all known, by backtracking over longest matches."""
        size = len(text)
        longest: list[str] = [""] * (size + 1)
        for end, (back, piece) in self.matches.iter(text):
            longest[end - back] = piece  # ends only grow, so the last match of a place is its longest
        open_places = bytearray(b"\x01") * (size + 1)
        pieces: list[str] = []
        at, candidate = 0, longest[0]
        compatible, shorter = self.compatible, self.shorter
        while at < size:
            last = pieces[-1] if pieces else None
            while candidate is not None:
                end = at + len(candidate)
                if open_places[end] and (last is None or compatible[last, candidate]):
                    break
                candidate = shorter[candidate]
            if candidate is not None:
                pieces.append(candidate)
                at += len(candidate)
                candidate = longest[at]
            else:
                open_places[at] = 0
                pieces.pop()
                at -= len(last)
                candidate = last
        return pieces

    def word_ids(self, text: str) -> list[int]:
        """Ids of a stretch without a space mark after another character and at most one in front."""
        if self.known.issuperset(text):
            return [self.id_of[piece] for piece in self.covered(text)]
        ids: list[int] = []
        start = 0
        for at, character in enumerate([*text, None]):
            if character is None or character not in self.known:
                if start < at:
                    ids += [self.id_of[piece] for piece in self.covered(text[start:at])]
                ids += [self.byte_id[byte] for byte in (character or "").encode()]
                start = at + 1
        return ids

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of spaces followed by other characters."""
        word = unit.lstrip(" ")
        spaces = len(unit) - len(word)
        if spaces == 1:
            return self.word_ids(SPACE + word)
        ids = self.word_ids(SPACE + word) if word and spaces else self.word_ids(word)
        if word and spaces and ids[0] != self.id_of[SPACE]:
            spaces -= 1  # the word took the last space
        elif word and spaces:
            ids = ids[1:]
        return [self.id_of[piece] for piece in self.merged(SPACE * spaces)] + ids

    def described(self, unit: str) -> tuple[int, str, str]:
        ids = self.unit_ids(unit)
        plain = [self.plain_surface[i] for i in ids]
        return len(ids), ",".join(map(str, ids)), self.surface(ids) if None in plain else "".join(plain)

    def units(self, text: str) -> list[tuple[int, str, str]]:
        """For each unit of a text with its added first space: the number of ids, the ids and their decoded text."""
        spaced = text.replace(SPACE, " ")
        if "  " not in spaced and spaced[0] != " " and spaced[-1] != " ":
            return list(map(self.words.__getitem__, spaced.split(" ")))
        return [self.described(unit) if unit[:2] == "  " else self.words[unit[1:]] for unit in _SPACED.findall(" " + spaced)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return [int(i) for _, ids, _ in self.units(text) for i in ids.split(",")]

    def surface(self, ids: list[int]) -> str:
        """Text of the ids, an added first space included."""
        parts: list[str] = []
        data = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                data.append(self.byte_of[i])
                continue
            if data:
                parts.append(fallback_text(bytes(data)))
                data.clear()
            if i is not None and i not in self.control:
                parts.append(UNKNOWN_SURFACE if i == self.unknown else self.piece[i].replace(SPACE, " "))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        first = next((i for i in ids if i not in self.control), None)
        added = first is not None and first not in self.byte_of and self.piece[first].startswith(SPACE)
        return text[1:] if added else text


_SPACED = re.compile(r" +[^ ]*")


def fallback_text(data: bytes) -> str:
    """UTF-8 of fallback bytes; every byte that belongs to no character becomes one replacement character."""
    parts: list[str] = []
    at = 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                parts.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            parts.append("�")
            at += 1
    return "".join(parts)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> PieceVocabulary:
    """One vocabulary per worker process and file."""
    return PieceVocabulary(path)


def encode_decode(documents: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Number and digest of the ids of each whole text, and the digest of the text decoded from them. No shuffle."""

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def work(rows: dict[str, list]) -> dict[str, list]:
        pieces = vocabulary(model)
        counts, ids, texts = [], [], []
        for text in rows["text"]:
            parts = pieces.units(text) if text else []
            counts.append(sum(part[0] for part in parts))
            ids.append(digest(",".join([part[1] for part in parts])))
            texts.append(digest("".join([part[2] for part in parts])[1:]))
        return {"doc_id": rows["doc_id"], "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": texts}

    kind = documents.schema[id_column].dataType.simpleString()
    return arrow_rows(
        fields(documents, doc_id=id_column, text=text_column),
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        work,
    )


def encode_ids(documents: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ids of each whole text as an array."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        pieces = vocabulary(model)
        return {"doc_id": rows["doc_id"], "ids": [pieces.encode(text) for text in rows["text"]]}

    kind = documents.schema[id_column].dataType.simpleString()
    return arrow_rows(fields(documents, doc_id=id_column, text=text_column), f"doc_id {kind}, ids array<int>", work)


def decode_ids(encoded: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The text of each array of ids; null and empty arrays give empty text."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        pieces = vocabulary(model)
        return {"doc_id": rows["doc_id"], "text": [pieces.decode(ids or []) for ids in rows["ids"]]}

    kind = encoded.schema[id_column].dataType.simpleString()
    return arrow_rows(fields(encoded, doc_id=id_column, ids=ids_column), f"doc_id {kind}, text string", work)
