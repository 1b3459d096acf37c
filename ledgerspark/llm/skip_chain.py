"""Operator 5: personal data by fixed patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. They miss another spelling of the same
thing, such as a phone number without its plus sign. The field labels every token with a digit or an at sign; all
other tokens carry no label, which cuts the chain between its pieces. Neighbouring tokens share transition
potentials, and each token is linked to the next one in the document with the same key (its last seven digits, or its
text without case), however far away: such a link has agreement potentials. A number may be written in groups: a pattern
match, and neighbouring tokens up to any one of them, have the last seven of their joined digits as a key, and tokens of two such
numbers are linked where their digits agree. Tokens inside pattern matches are
observed. Loopy sum-product message passing carries their labels along chain and links.

The weights are learned by pseudo-likelihood from pattern matches of a bounded sample of documents, with a prior of
``AGREEMENT`` for equal labels across a link. A run of tokens becomes an added span if each token has the label with
probability ``CERTAIN`` at least, and one of them is linked, maybe over others, to an observed token with that label; further neighbours with such a link join it. Pattern matches
always stay.

Defined results: a null text is an empty text; spans are code points, end exclusive; without matches to learn from
nothing is added; repeated rows are searched each; an empty table gives an empty result; only the id and text columns
are read, except by ``masked``, which keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, arrow_rows, fields, importable

#: Kinds in their fixed order; label 0 is no entity, label k + 1 is KINDS[k].
KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
BUCKETS = 1 << 12
AGREEMENT, CERTAIN, ROUNDS = 4.0, 0.9, 12
#: Documents the potentials are learned from, at most, and tokens of them.
SAMPLE, SAMPLE_TOKENS = 4_000, 60_000

_SIGN = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always starts a run of digits, so the look-behind only spares useless attempts.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS, _LETTERS = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+")
_EDGE = ".,;:!?\"'*&%$#|<>"
_BETWEEN = re.compile(r"[\x20\x09-\x0D().-]+")
#: Digits of a key, and most digits of a pattern match.
KEY_DIGITS, MOST_DIGITS = 7, 19

Span = tuple[str, int, int]
#: Tokens of a number in their order, each with its digits.
Number = list[tuple[int, str]]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs so that long runs cost linear time."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(free, at + 1))
    return found


def passes_luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Matches of the four patterns, by start and then kind."""
    if not _SIGN.search(text):
        return []
    found: list[Span] = [("email", *span) for span in emails(text)]
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match.group().split(".")):
            found.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", match.group())
        if 14 <= len(digits) <= 19 and passes_luhn(digits):
            found.append(("card", *match.span()))
    for match in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", match.group())) <= 15:
            found.append(("phone", *match.span()))
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


class Tokens:
    """The tokens of a text that may carry a label, their observed labels, chain neighbours and links."""

    def __init__(self, text: str, spans: list[Span]) -> None:
        words = [(m.start(), m.end()) for m in WORDS.finditer(text)]
        picked = [(n, *edges(text, *word)) for n, word in enumerate(words) if _SIGN.search(text, *word)]
        self.bounds = [(start, end) for _, start, end in picked]
        self.texts = [text[start:end] for start, end in self.bounds]
        self.observed = np.zeros(len(picked), dtype=np.int64)
        # Both lists ascend, so one sweep finds the spans that a token touches; the first kind wins.
        first = 0
        by_end = sorted(spans, key=lambda span: span[1])
        for i, (start, end) in enumerate(self.bounds):
            while first < len(by_end) and by_end[first][2] <= start:
                first += 1
            for kind, left, right in by_end[first : first + len(KINDS)]:
                if left < end and start < right:
                    self.observed[i] = KINDS.index(kind) + 1
                    break
        place = np.array([n for n, _, _ in picked], dtype=np.int64)
        self.chain = np.flatnonzero(np.diff(place) == 1) if len(place) else place
        # Each occurrence is linked to the next: as many links as tokens and their digits, never all pairs.
        groups: dict[str, list[Number]] = defaultdict(list)
        for key, number in self.numbers(text, spans):
            groups[key].append(number)
        pairs = {pair for group in groups.values() for one, other in zip(group, group[1:]) for pair in agreeing(one, other)}
        self.links = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.features = [token_features(token) for token in self.texts]

    def numbers(self, text: str, spans: list[Span]) -> list[tuple[str, Number]]:
        """Keys with their tokens, by last token: single tokens, runs of tokens outside matches, and matches."""
        digits = [_NOT_DIGIT.sub("", token) for token in self.texts]
        found: dict[tuple[int, str], Number] = {}
        for i, token in enumerate(self.texts):
            if key := link_key(token):
                found[i, key] = [(i, digits[i])]
        run: list[int] = []
        for i, token in enumerate(self.texts):
            if self.observed[i] or "@" in token or not digits[i]:
                run = []
                continue
            joins = run and token[0] in "0123456789(" and self.texts[i - 1][-1] in "0123456789)-"
            if not (joins and _BETWEEN.fullmatch(text, self.bounds[i - 1][1], self.bounds[i][0])):
                run = []
            # Every token has a digit, so this many tokens hold all that can agree.
            run = [*run[1 - MOST_DIGITS :], i]
            if len(run) > 1:
                add_number(found, [(j, digits[j]) for j in run])
        first = 0
        for _, left, right in sorted((span for span in spans if span[0] != "email"), key=lambda span: (span[1], span[2])):
            while first < len(self.bounds) and self.bounds[first][1] <= left:
                first += 1
            last = first
            while last < len(self.bounds) and self.bounds[last][0] < right:
                last += 1
            if last - first > 1:
                cut = [(max(left, start), min(right, end)) for start, end in self.bounds[first:last]]
                parts = [(j, _NOT_DIGIT.sub("", text[start:end])) for j, (start, end) in enumerate(cut, first)]
                add_number(found, [part for part in parts if part[1]])
        return [(key, number) for (_, key), number in sorted(found.items(), key=lambda item: item[0])]

    def groups(self) -> list[int]:
        """For each token the first one that links connect it to."""
        parent = list(range(len(self.texts)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in self.links.tolist():
            low, high = sorted((find(i), find(j)))
            parent[high] = low
        return [find(i) for i in range(len(parent))]


def add_number(found: dict[tuple[int, str], Number], parts: Number) -> None:
    joined_digits = "".join(digits for _, digits in parts)
    if len(joined_digits) >= KEY_DIGITS:
        found[parts[-1][0], joined_digits[-KEY_DIGITS:]] = parts


def agreeing(one: Number, other: Number) -> list[tuple[int, int]]:
    """Pairs (smaller, larger) of tokens that hold the same digits, counted from the end of two numbers; texts without digits agree."""
    left, right = ("".join(digits for _, digits in number)[-MOST_DIGITS:] for number in (one, other))
    same = 0
    while same < min(len(left), len(right)) and left[-1 - same] == right[-1 - same]:
        same += 1
    if not same:
        return [(one[-1][0], other[-1][0])] if one[-1][0] != other[-1][0] else []
    pairs, i, j = [], len(one) - 1, len(other) - 1
    ends = [len(one[i][1]), len(other[j][1])]
    while True:
        # A token whose further digits differ or are missing agrees if it starts within the shared end.
        if min(ends) <= same and one[i][0] != other[j][0]:
            pairs.append((min(one[i][0], other[j][0]), max(one[i][0], other[j][0])))
        elif min(ends) > same and i == len(one) - 1 and j == len(other) - 1 and one[i][0] != other[j][0]:
            pairs.append((min(one[i][0], other[j][0]), max(one[i][0], other[j][0])))
        if ends[0] <= ends[1]:
            i, step = i - 1, 0
        else:
            j, step = j - 1, 1
        if ends[step] >= same or i < 0 or j < 0:
            return pairs
        ends[step] += len(one[i][1] if step == 0 else other[j][1])


def edges(text: str, start: int, end: int) -> tuple[int, int]:
    """A word without the punctuation at its ends."""
    while start < end - 1 and text[start] in _EDGE:
        start += 1
    while end > start + 1 and text[end - 1] in _EDGE:
        end -= 1
    return start, end


def link_key(token: str) -> str:
    """What similar tokens share: the last seven digits, or the text without case; empty for short numbers."""
    digits = _NOT_DIGIT.sub("", token)
    if "@" in token:
        return token.casefold()
    return digits[-KEY_DIGITS:] if len(digits) >= KEY_DIGITS else ""


def token_features(token: str) -> list[int]:
    """Hashed shape, length and check-digit features of one token."""
    digits = _NOT_DIGIT.sub("", token)
    shape = _LETTERS.sub("a", _DIGITS.sub("9", token))
    short = re.sub(r"(.)\1+", r"\1", shape)[:24]
    names = ["bias", f"shape={shape[:24]}", f"short={short}", f"digits={min(len(digits), 20)}", f"first={token[:1]}"]
    if 14 <= len(digits) <= 19:
        names.append(f"luhn={passes_luhn(digits)}")
    return [zlib.crc32(name.encode()) % BUCKETS for name in names]


class SkipChainModel:
    """Unary weights, transition potentials of neighbours and agreement potentials of links."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, link: np.ndarray) -> None:
        self.unary, self.chain, self.link = unary, chain, link

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Loopy sum-product: probability of each label for each token, with matched tokens observed."""
        size = len(tokens.texts)
        local = np.array([self.unary[f].sum(axis=0) for f in tokens.features]).reshape(size, LABELS)
        seen = tokens.observed > 0
        local[seen] = -50.0
        local[seen, tokens.observed[seen]] = 0.0
        pairs = np.concatenate([np.stack([tokens.chain, tokens.chain + 1], axis=1), tokens.links])
        kinds = np.repeat([0, 1], [len(tokens.chain), len(tokens.links)])
        potentials = np.stack([self.chain, self.link])[kinds]  # edge, first label, second label
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        tables = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.zeros((len(source), LABELS))
        beliefs = local
        for _ in range(ROUNDS):
            arriving = beliefs[source] - messages[back]
            raw = tables + arriving[:, :, None]
            top = raw.max(axis=1, keepdims=True)
            fresh = np.log(np.exp(raw - top).sum(axis=1)) + top[:, 0]
            messages = 0.5 * messages + 0.5 * (fresh - fresh.max(axis=1, keepdims=True))
            beliefs = local + np.stack([np.bincount(target, messages[:, k], size) for k in range(LABELS)], axis=1)
        chances = np.exp(beliefs - beliefs.max(axis=1, keepdims=True))
        return chances / chances.sum(axis=1, keepdims=True)

    def added_spans(self, text: str, spans: list[Span]) -> list[Span]:
        """Spans of consistent labels that the patterns did not match."""
        if not spans:
            return []  # no observed label to be consistent with
        tokens = Tokens(text, spans)
        groups = tokens.groups()
        support = {(group, label) for group, label in zip(groups, tokens.observed.tolist()) if label}
        supported = {group for group, _ in support}
        if not any(group in supported for group, label in zip(groups, tokens.observed) if not label):
            return []
        chances = self.marginals(tokens)
        labels = np.where(tokens.observed > 0, 0, chances.argmax(axis=1))
        labels[chances.max(axis=1) < CERTAIN] = 0
        # Groups of digits are certain together: the rest of a number that is linked to the same match follows its neighbour.
        steps = [(i, i + 1) for i in tokens.chain.tolist()]
        for i, j in [*steps, *((j, i) for i, j in reversed(steps))]:
            if labels[i] and not labels[j] and not tokens.observed[j] and (groups[j], labels[i]) in support:
                labels[j] = labels[i]
        joined = set(tokens.chain.tolist())
        added: list[Span] = []
        i = 0
        while i < len(labels):
            last = i
            while labels[i] and last in joined and labels[last + 1] == labels[i]:
                last += 1
            if labels[i] and any((groups[j], labels[i]) in support for j in range(i, last + 1)):
                added.append((KINDS[labels[i] - 1], tokens.bounds[i][0], tokens.bounds[last][1]))
            i = last + 1
        return added

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Pattern matches, and all spans, by start and then kind."""
        base = pattern_spans(text)
        added = self.added_spans(text, base)
        return base, sorted(base + added, key=lambda span: (span[1], KINDS.index(span[0]))) if added else base


def fit(rows: list[tuple[list[int], int, list[int], list[int]]], rounds: int = 200, penalty: float = 1e-3) -> SkipChainModel:
    """Pseudo-likelihood: each token's label given its features and the labels of its neighbours and links.

    A row holds features, label, labels of chain neighbours (the one before as label, the one after as label + LABELS)
    and labels across links.
    """
    size = BUCKETS + 2 * LABELS + LABELS
    names = [[*f, *(BUCKETS + n for n in near), *(BUCKETS + 2 * LABELS + n for n in linked)] for f, _, near, linked in rows]
    owner = np.repeat(np.arange(len(rows)), [len(n) for n in names])
    flat = np.array([n for row in names for n in row], dtype=np.int64)
    labels = np.array([label for _, label, _, _ in rows], dtype=np.int64)
    prior = np.zeros((size, LABELS))
    prior[-LABELS:] = AGREEMENT * np.eye(LABELS)
    weights = prior.copy()
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    truth = np.eye(LABELS)[labels]
    for step in range(1, rounds + 1):
        logits = np.stack([np.bincount(owner, weights[flat, k], len(rows)) for k in range(LABELS)], axis=1)
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        wrong = (chance - truth) / len(rows)
        slope = np.stack([np.bincount(flat, wrong[owner, k], size) for k in range(LABELS)], axis=1) + penalty * (weights - prior)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    before, after = weights[BUCKETS : BUCKETS + LABELS], weights[BUCKETS + LABELS : BUCKETS + 2 * LABELS]
    link = weights[-LABELS:]
    # Rows are the first token's label; an edge has one potential, the mean of what its two ends learned.
    return SkipChainModel(weights[:BUCKETS], (before + after.T) / 2, (link + link.T) / 2)


def training_rows(text: str) -> list[tuple[list[int], int, list[int], list[int]]]:
    tokens = Tokens(text, pattern_spans(text))
    near: list[list[int]] = [[] for _ in tokens.texts]
    linked: list[list[int]] = [[] for _ in tokens.texts]
    for i in tokens.chain.tolist():
        near[i + 1].append(int(tokens.observed[i]))
        near[i].append(int(tokens.observed[i + 1]) + LABELS)
    for i, j in tokens.links.tolist():
        linked[i].append(int(tokens.observed[j]))
        linked[j].append(int(tokens.observed[i]))
    return list(zip(tokens.features, map(int, tokens.observed), near, linked))


def train(documents: DataFrame, sample: int = SAMPLE, tokens: int = SAMPLE_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> SkipChainModel:
    """Learn from at most ``tokens`` tokens of the ``sample`` documents with a digit or at sign that come first by hash."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = [row for text in rows["text"] for row in training_rows(text)]
        columns = list(zip(*found)) or [[], [], [], []]
        return dict(zip(("features", "label", "near", "linked"), map(list, columns)))

    source = fields(documents, doc_id=id_column, text=text_column).where(F.col("text").rlike("[0-9@]"))
    order = F.xxhash64("doc_id", "text")
    # Ids are picked before texts move: a sort of whole texts is not needed to take the first few.
    picked = source.select(order.alias("order")).distinct().orderBy("order").limit(sample)
    chosen = source.withColumn("order", order).join(F.broadcast(picked), "order").select("text")
    rows = arrow_rows(chosen, "features array<int>, label int, near array<int>, linked array<int>", work)
    known = rows.orderBy(F.xxhash64("features", "label", "near", "linked")).limit(tokens).collect()
    if not known:
        zero = np.zeros((LABELS, LABELS))
        return SkipChainModel(np.zeros((BUCKETS, LABELS)), zero, AGREEMENT * np.eye(LABELS))
    return fit([tuple(row) for row in known])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def found_spans(documents: DataFrame, model: SkipChainModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Numbers of pattern matches by kind, a digest of them, and all spans with the added ones. No shuffle."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        pairs = [model.spans(text or "") for text in rows["text"]]
        out: dict[str, list] = {"doc_id": rows["doc_id"]}
        for kind in KINDS:
            out[f"n_{kind}"] = [sum(span[0] == kind for span in base) for base, _ in pairs]
        out["base_sha256"] = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in pairs]
        out["spans"] = [joined(spans) for _, spans in pairs]
        return out

    kind = documents.schema[id_column].dataType.simpleString()
    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string"
    return arrow_rows(fields(documents, doc_id=id_column, text=text_column), schema, work)


def mask_text(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    parts, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def masked(documents: DataFrame, model: SkipChainModel) -> DataFrame:
    """The documents, all columns kept, with spans in ``text`` masked and ``n_chars`` counted anew. No shuffle."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: text if text is None else mask_text(text, model.spans(text)[1]))

    clean = importable(documents).withColumn("text", mask("text"))
    if "n_chars" not in documents.columns:
        return clean
    length = F.length("text").cast(documents.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
