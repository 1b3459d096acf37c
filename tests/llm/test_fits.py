"""The fits of operators 1 and 3 against plain loops, and their scores against the written formulas."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from ledgerspark.llm import ranking, severity


def logistic(x):
    return 1 / (1 + math.exp(-x))


class Adam:
    """The steps both fits take, one value at a time."""

    def __init__(self, size, rate, floor):
        self.first, self.second, self.rate, self.floor, self.step = [0.0] * size, [0.0] * size, rate, floor, 0

    def moved(self, values, slopes):
        self.step += 1
        out = []
        for i, (value, slope) in enumerate(zip(values, slopes)):
            self.first[i] = 0.9 * self.first[i] + 0.1 * slope
            self.second[i] = 0.99 * self.second[i] + 0.01 * slope**2
            mean, spread = self.first[i] / (1 - 0.9**self.step), self.second[i] / (1 - 0.99**self.step)
            out.append(value - self.rate * mean / (math.sqrt(spread) + self.floor))
        return out


def test_pair_loss_by_plain_loops(monkeypatch):
    monkeypatch.setattr(ranking, "PAIRS", 250)
    draw = np.random.default_rng(5)
    matrix = draw.normal(size=(60, ranking.FEATURES))
    labels = (matrix[:, 2] - matrix[:, 5] + 0.5 * draw.normal(size=60) > 0).astype(int)
    penalty, rounds = 1e-3, 7
    model = ranking.fit(matrix, labels, penalty, rounds)

    good, bad = [i for i in range(60) if labels[i]], [i for i in range(60) if not labels[i]]
    pairs = np.random.default_rng(7)
    winners = [good[i] for i in pairs.integers(len(good), size=250)]
    losers = [bad[i] for i in pairs.integers(len(bad), size=250)]
    bins = [[sum(value >= edge for edge in model.edges[j]) + j * ranking.BINS for j, value in enumerate(row)] for row in matrix]
    weights, steps = [0.0] * (ranking.FEATURES * ranking.BINS), Adam(ranking.FEATURES * ranking.BINS, 0.1, 1e-9)
    for _ in range(rounds):
        slopes = [penalty * weight for weight in weights]
        for winner, loser in zip(winners, losers):
            difference = sum(weights[b] for b in bins[winner]) - sum(weights[b] for b in bins[loser])
            doubt = 1 - logistic(difference)  # the loss is -log logistic(difference)
            for b in bins[winner]:
                slopes[b] -= doubt / 250
            for b in bins[loser]:
                slopes[b] += doubt / 250
        weights = steps.moved(weights, slopes)
    assert model.weights == pytest.approx(weights, abs=1e-6)

    strengths = [sum(weights[b] for b in row) for row in bins]
    share = len(bad) / 60
    threshold = sorted(strengths)[math.ceil(share * 59)]  # the quantile, taken at the next value above
    assert model.threshold == pytest.approx(threshold, abs=1e-6)
    for row, strength in zip(model.score(matrix), strengths):
        odds = 0.3 / 0.7 * math.exp(strength - threshold)
        assert row == pytest.approx(odds / (1 + odds), abs=1e-6)


def made_rows():
    draw = random.Random(3)
    marks = [f"bad{i}" for i in range(6)]
    rows, counts = [], []
    for _ in range(240):
        many = draw.choice([0, 0, 1, 2, 4])
        rows.append(np.array(severity.text_features(" ".join([f"w{draw.randrange(12)}" for _ in range(6)] + draw.sample(marks, many)))))
        counts.append(many)
    return rows, np.array(counts), marks


def test_cumulative_link_by_plain_loops():
    rows, counts, _ = made_rows()
    grades = np.minimum(counts, 3)
    penalty, rounds = 1e-3, 6
    model = severity.fit(rows, grades, penalty, rounds)
    names = list(severity.telling(rows, grades))
    place = {name: i for i, name in enumerate(names)}
    listed = [[place[f] for f in row.tolist() if f in place] for row in rows]
    levels = severity.GRADES - 1
    thresholds = []
    for k in range(1, levels + 1):
        share = min(max(sum(grade >= k for grade in grades) / len(grades), 1e-4), 1 - 1e-4)
        thresholds.append(max([-math.log(share / (1 - share)) + (k - 1) * 1e-3, *thresholds[-1:]]))

    def loss(values):
        """Mean negative log-likelihood and the penalty, from the definition."""
        weights, cuts = values[: len(names)], values[len(names) :]
        total = 0.0
        for row, grade in zip(listed, grades):
            strength = sum(weights[i] for i in row)
            above = [1.0, *(logistic(strength - cut) for cut in cuts), 0.0]
            total -= math.log(above[grade] - above[grade + 1])
        return total / len(listed) + penalty / 2 * sum(weight**2 for weight in weights)

    values = [0.0] * len(names) + thresholds
    steps = Adam(len(values), 0.1, 1e-8)
    for _ in range(rounds):
        slopes = []
        for i in range(len(values)):
            more, less = list(values), list(values)
            more[i] += 1e-5
            less[i] -= 1e-5
            slopes.append((loss(more) - loss(less)) / 2e-5)
        before = loss(values)
        values = steps.moved(values, slopes)
        for i in range(len(names) + 1, len(values)):
            values[i] = max(values[i] + (i - len(names)) * 1e-6, values[i - 1])
        assert loss(values) < before
    assert model.thresholds == pytest.approx(values[len(names) :], abs=2e-3)
    assert model.weights[names] == pytest.approx(values[: len(names)], abs=2e-3)


def test_expected_severity_from_the_formula(spark):
    rows, counts, marks = made_rows()
    model = severity.fit(rows, np.minimum(counts, 3))
    texts = [(i, " ".join(marks[:i]) + " w1 w2") for i in range(5)] + [(5, None), (6, "")]
    found = {row.doc_id: row for row in severity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, text in texts:
        strength = sum(float(model.weights[f]) for word in set((text or "").lower().split()) for f in severity.word_features(word))
        reached = [logistic(strength - cut) for cut in model.thresholds]
        chances = [a - b for a, b in zip([1.0, *reached], [*reached, 0.0])]
        assert found[i].expected_severity == pytest.approx(sum(reached), abs=1e-9)
        assert found[i].expected_severity == pytest.approx(sum(k * chance for k, chance in enumerate(chances)), abs=1e-9)
        assert found[i].toxic_probability == pytest.approx(reached[0], abs=1e-9) and found[i].grade == chances.index(max(chances))
