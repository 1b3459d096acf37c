"""Operator 3: a quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear score of its features, and a document labelled good is preferred to one labelled
bad with probability sigma(difference of scores). The weights minimise the logistic loss on feature differences of
such pairs. The decision threshold is a quantile of the scores of the labelled sample, at the share of bad documents
in it; the score is shifted so that the threshold lies at ``cut``.

Features describe the whole text: length, repetition of words, word pairs and lines, symbols, letter case, digits
and compressibility. Each is cut into bins at quantiles of the sample, so that a feature may count against
a document at both ends. The labelled sample has at most ``sample`` rows, a parameter; everything else covers all rows.

Defined results: null and empty texts get the score of a text without words; without labels of both kinds every
score is 0.5; ties at the threshold are accepted; repeated rows are scored each; an empty table gives an empty
result; of the documents only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fields, fold, importable, labelled_sample, words_of

FEATURES = 14
BINS = 20
#: At and above this score a document is accepted.
CUT = 0.3
#: Labelled rows the model is fitted on, at most, and preference pairs drawn from them.
SAMPLE, PAIRS = 20_000, 400_000

_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"[0-9]")


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all zero without words."""
    words = words_of(text)
    size = len(words)
    if not size:
        return [0.0] * FEATURES
    chars = sum(map(len, words))
    distinct = set(words)
    pairs = set(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    raw = text.encode()
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(size)),
        len(distinct) / size,
        len(pairs) / max(size - 1, 1),
        repeats / size,
        1 - len(set(lines)) / len(lines),
        len(zlib.compress(raw, 1)) / len(raw),
        len(_SYMBOL.findall(text)) / size,
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        chars / size,
        text.count("!") / size,
        (text.count(".") + text.count("?")) / size,
        text.count(",") / size,
        float(np.log1p(size / len(lines))),
    ]


class RankingModel:
    """Bin edges of the features, a weight for each bin, and the score that the cut corresponds to."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, threshold: float) -> None:
        self.edges, self.weights, self.threshold = edges, weights, threshold

    def bins(self, matrix: np.ndarray) -> np.ndarray:
        """For each row, the numbers of the bins its features fall into."""
        places = [np.searchsorted(edge, matrix[:, j], side="right") for j, edge in enumerate(self.edges)]
        return np.stack(places, axis=1) + np.arange(len(self.edges)) * BINS

    def strength(self, matrix: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(matrix)].sum(axis=1)

    def score(self, matrix: np.ndarray, cut: float = CUT) -> np.ndarray:
        # At the threshold the score is exactly the cut, so that ties there are accepted.
        odds = cut / (1 - cut) * np.exp(np.clip(self.strength(matrix) - self.threshold, -500, 500))
        return odds / (1 + odds)


def fit(matrix: np.ndarray, labels: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> RankingModel | None:
    """Fit on labelled feature rows; None unless both labels occur."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels != 1)
    if not len(good) or not len(bad):
        return None
    tails = [0.005, 0.01, 0.02, 0.04]  # finer at both ends, where bad documents lie
    shares = np.array([*tails, *np.linspace(0, 1, BINS - 7)[1:-1], *(1 - share for share in reversed(tails))])
    edges = [np.unique(np.quantile(matrix[:, j], shares)) for j in range(matrix.shape[1])]
    model = RankingModel(edges, np.zeros(matrix.shape[1] * BINS), 0.0)
    bins = model.bins(matrix)
    draw = np.random.default_rng(7)
    winners, losers = good[draw.integers(len(good), size=PAIRS)], bad[draw.integers(len(bad), size=PAIRS)]
    weights, size = model.weights, len(matrix)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        strength = weights[bins].sum(axis=1)
        doubt = 1 / (1 + np.exp(np.clip(strength[winners] - strength[losers], -500, 500)))
        pull = np.bincount(winners, doubt, size) - np.bincount(losers, doubt, size)
        slope = -np.bincount(bins.ravel(), np.repeat(pull, bins.shape[1]), len(weights)) / PAIRS + penalty * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    model.threshold = float(np.quantile(model.strength(matrix), len(bad) / len(matrix), method="higher"))
    return model


def feature_rows(documents: DataFrame, *carried: str) -> DataFrame:
    """Columns doc_id and carried ones, and the features of each whole text."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {name: rows[name] for name in ("doc_id", *carried)} | {"features": list(map(features, rows["text"]))}

    types = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join(f"`{name}` {types[name]}" for name in ("doc_id", *carried)) + ", features array<double>"
    return arrow_rows(documents.select("doc_id", "text", *carried), schema, work)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 5) -> RankingModel | None:
    """Fit on a bounded sample of labelled documents outside fold 0. Only its feature rows reach the driver."""
    source = fields(documents, doc_id="doc_id", text="text")
    rows = feature_rows(labelled_sample(source, labels, label, sample, lambda doc_id: fold(doc_id, folds) != 0), "label")
    # An id that many rows share must not swell the sample.
    known = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).limit(sample).collect()
    if not known:
        return None
    return fit(np.array([row.features for row in known]), np.array([row.label for row in known]))


def score(documents: DataFrame, model: RankingModel | None, cut: float = CUT, folds: int = 5) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted. No shuffle."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        matrix = np.array(list(map(features, rows["text"])))
        scores = model.score(matrix, cut) if model else np.full(len(matrix), 0.5)
        return {"doc_id": rows["doc_id"], "score": scores, "predicted": (scores >= cut).astype(np.int32)}

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = arrow_rows(fields(documents, doc_id="doc_id", text="text"), f"doc_id {kind}, score double, predicted int", work)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted")


def accepted(documents: DataFrame, model: RankingModel | None, cut: float = CUT) -> DataFrame:
    """The documents, all columns kept, whose score reaches the cut. No shuffle."""

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.ones(len(texts), dtype=bool))
        return pd.Series(model.score(np.array(list(map(features, texts))).reshape(-1, FEATURES), cut) >= cut)

    return importable(documents).where(good("text"))
