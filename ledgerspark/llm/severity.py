"""Operator 1: toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades 0 to 3 are ordered, and the probability of at least grade k is sigma(w.x - threshold_k): one weight vector is
shared by all thresholds. x counts hashed features of the distinct words of a text that tell toxic from clean rows: the word, and its first four,
five and six letters, which carry over to words never seen in training. The expected severity is the sum of the
three probabilities.

Labels only say toxic or not, so the grades of the training sample are set from the sample itself: clean documents
have grade 0; toxic ones have grade 1 to 3 by thirds of the number of marker words in them, words at least
``MARKER_LIFT`` times as frequent in toxic as in clean documents of the sample. The sample has at most ``sample``
labelled rows, a parameter; every document is scored over its whole text.

Defined results: null and empty texts have no features and get the severity of the thresholds alone; without labels
of both kinds all severities are 0; repeated rows are scored each; an empty table gives an empty result; of the
documents only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, arrow_rows, fields, labelled_sample

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
GRADES = 4
#: Labelled rows the model is fitted on, at most.
SAMPLE = 12_000
LEAST_CHI_SQUARE = 20.0
#: From this chance of grade 1 or more on, a document counts as toxic.
CUT = 0.15
MARKER_LIFT, MARKER_DOCUMENTS = 10.0, 4
#: Characters cut off the ends of words.
EDGES = ".,;:!?*&%$#|<>\"'()[]{}+-/=_"


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one word; the first is the word itself. None for a word without letters."""
    core = word.strip(EDGES)
    if not core or core.isdigit():
        return ()
    names = [core, *(f"^{core[:n]}" for n in PREFIXES if len(core) >= n)]
    return tuple(zlib.crc32(name.encode()) % BUCKETS for name in names)


_features = BoundedCache(word_features)


def text_features(text: str | None) -> list[int]:
    """Features of the distinct words of a text, with repeats where words share a feature."""
    return [f for word in set((text or "").lower().split()) for f in _features[word]]


def marker_buckets(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features far more frequent in toxic than in clean rows."""
    counts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for row, label in zip(rows, toxic):
        counts[int(label)][np.unique(row)] += 1
    clean, marked = counts
    share = (marked / max(toxic.sum(), 1)) / ((clean + 0.5) / max((1 - toxic).sum(), 1))
    return (share >= MARKER_LIFT) & (marked >= MARKER_DOCUMENTS)


def grades_of(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows, 1 to 3 for toxic rows by thirds of their number of markers."""
    markers = marker_buckets(rows, toxic)
    found = np.array([markers[row].sum() for row in rows])
    low, high = np.quantile(found[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (found > low) + (found > high), 0)


def sigma(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class SeverityModel:
    """Shared weights and the ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds
        self.word_weight = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"word_weight": None}

    def strength(self, text: str | None) -> float:
        """w.x of a whole text. The sum is exact, so it depends on no order of words."""
        if self.word_weight is None:
            self.word_weight = BoundedCache(lambda word: float(sum(float(self.weights[f]) for f in word_features(word))))
        return math.fsum(map(self.word_weight.__getitem__, set((text or "").lower().split())))

    def exceedance(self, strengths: np.ndarray) -> np.ndarray:
        """For each strength, the probabilities of at least grade 1, 2 and 3."""
        return sigma(strengths[:, None] - self.thresholds)


def telling(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Features whose chi-square between toxic and clean rows shows more than chance."""
    toxic = grades > 0
    clean, marked = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, is_toxic in zip(rows, toxic):
        (marked if is_toxic else clean)[np.unique(row)] += 1
    seen, share = clean + marked, toxic.mean()
    chi_square = (marked - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-12)
    return np.flatnonzero((chi_square >= LEAST_CHI_SQUARE) & (seen >= MARKER_DOCUMENTS))


def fit(rows: list[np.ndarray], grades: np.ndarray, penalty: float = 1e-5, rounds: int = 400, rate: float = 0.1) -> SeverityModel:
    """Penalised likelihood of the cumulative-link model by adaptive gradient steps over the telling features."""
    size = len(rows)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(size), [len(row) for row in rows])
    names = telling(rows, grades)
    keep = np.isin(flat, names)
    columns, owner = np.searchsorted(names, flat[keep]), owner[keep]
    at_least = np.array([(grades >= k).mean() for k in range(1, GRADES)]).clip(1e-4, 1 - 1e-4)
    thresholds = np.maximum.accumulate(-np.log(at_least / (1 - at_least)) + np.arange(GRADES - 1) * 1e-3)
    values = np.concatenate([np.zeros(len(names)), thresholds])
    first, second = np.zeros_like(values), np.zeros_like(values)
    rows_at = np.arange(size)
    for step in range(1, rounds + 1):
        weights, thresholds = values[: len(names)], values[len(names) :]
        above = np.ones((size, GRADES + 1))
        above[:, 1:GRADES] = sigma(np.bincount(owner, weights[columns], size)[:, None] - thresholds)
        above[:, GRADES] = 0
        own, following = above[rows_at, grades], above[rows_at, grades + 1]
        chance = np.maximum(own - following, 1e-9)
        pull = (1 - own - following) / size  # derivative of the log-likelihood by the strength
        push = np.bincount(grades, own * (1 - own) / chance, GRADES + 1)
        push -= np.bincount(grades + 1, following * (1 - following) / chance, GRADES + 1)
        slope = np.concatenate([penalty * weights - np.bincount(columns, pull[owner], len(names)), push[1:GRADES] / size])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        values = values - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        # Thresholds stay in order.
        values[len(names) :] = np.maximum.accumulate(values[len(names) :] + np.arange(GRADES - 1) * 1e-6)
    dense = np.zeros(BUCKETS, dtype=np.float32)
    dense[names] = values[: len(names)]
    return SeverityModel(dense, values[len(names) :])


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, used=None) -> SeverityModel | None:
    """Fit on a bounded sample of labelled documents. Only their hashed features reach the driver."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = [np.array(text_features(text), dtype=np.int32) for text in rows["text"]]
        return {"doc_id": rows["doc_id"], "label": rows["label"], "features": found}

    source = fields(documents, doc_id="doc_id", text="text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    labelled = labelled_sample(source, labels, label, sample, used).select("doc_id", "text", "label")
    rows = arrow_rows(labelled, f"doc_id {kind}, label int, features array<int>", work)
    rows = rows.withColumn("features", F.array_sort("features"))
    # Copies of one text teach once; an id that many rows share must not swell the sample.
    rows = rows.withColumn("text_hash", F.xxhash64("features")).dropDuplicates(["text_hash"])
    known = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(sample).toArrow()
    toxic = known.column("label").to_numpy()
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    features = [row.values.to_numpy() for row in known.column("features")]
    return fit(features, grades_of(features, toxic))


def score(documents: DataFrame, model: SeverityModel | None, cut: float = CUT) -> DataFrame:
    """Score every document: expected severity, most likely grade, chance of any toxicity, and whether it is toxic."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        strengths = np.zeros(len(rows["text"]))
        if model is None:
            reached = np.zeros((len(strengths), GRADES - 1))
        else:
            strengths[:] = [model.strength(text) for text in rows["text"]]
            reached = model.exceedance(strengths)
        chances = -np.diff(np.pad(reached, ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0))), axis=1)
        return {
            "doc_id": rows["doc_id"],
            "expected_severity": reached.sum(axis=1),
            "grade": chances.argmax(axis=1).astype(np.int32),
            "toxic_probability": reached[:, 0],
            "toxic": reached[:, 0] >= cut,
        }

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, expected_severity double, grade int, toxic_probability double, toxic boolean"
    return arrow_rows(fields(documents, doc_id="doc_id", text="text"), schema, work)
