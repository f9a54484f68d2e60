"""Toxicity by cumulative-link ordinal regression.

Severity grades are ordered: 0 for clean rows and 1 to ``GRADES`` - 1 for toxic ones, by the share
of words that only toxic rows of the sample use.  One weight vector is shared by all thresholds:
P(grade >= k) = sigmoid(w x - b_k), b_1 < b_2 < ...; the result is the expected severity.

Cases: a null or empty text has no features and severity of the intercepts alone (clean); null
labels teach nothing; with no toxic or no clean labelled row every document is scored clean;
repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import Vocabulary, labelled_sample, matrix, score_texts

GRADES = 4
#: Labelled rows used for fitting: at most so many of each label.
PER_LABEL = 3000
#: A document is rejected from this expected severity on; half of the step to the first toxic grade.
REJECT = 0.5


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def severity_grades(triples, toxic: np.ndarray, features: int) -> np.ndarray:
    """Grades of the sample rows from a binary label: toxic rows are cut into equal parts by the
    share of features whose smoothed odds of being toxic exceed 8."""
    rows, at, value = triples
    hit = np.bincount(at, toxic[rows], features)
    all_ = np.bincount(at, minlength=features)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    odds = ((hit + 0.5) / (n1 + 1)) / ((all_ - hit + 0.5) / (n0 + 1))
    dose = np.bincount(rows, np.where(odds[at] > 8, value**2, 0), len(toxic))
    marked = np.sort(dose[(toxic == 1) & (dose > 0)])
    if not len(marked):
        return toxic.astype(int)
    cuts = marked[[len(marked) * k // (GRADES - 1) for k in range(1, GRADES - 1)]]
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, dose, side="right"), 0)


def fit_ordinal(triples, grade: np.ndarray, features: int, steps: int = 200, ridge: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the mean log loss of the cumulative links.
    Thresholds are b_1 and positive increments, so that they stay ordered.  Each feature is scaled
    by its log odds of standing in a toxic row, so that words of everyday use carry little."""
    rows, at, value = triples
    n = len(grade)
    toxic = (grade > 0).astype(float)
    hit, all_ = np.bincount(at, toxic[rows], features), np.bincount(at, minlength=features)
    scale = np.log((hit + 1) / (toxic.sum() + 2)) - np.log((all_ - hit + 1) / (n - toxic.sum() + 2))
    value = value * scale[at]
    reached = (grade[:, None] >= np.arange(1, GRADES)[None]).astype(float)
    share = np.array([1.0, 1.0]) / np.bincount(reached[:, 0].astype(int), minlength=2).clip(1)
    weight = share[reached[:, 0].astype(int)] / 2 * n  # clean and toxic rows count alike
    theta = np.ones(features + GRADES - 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, b = theta[:features], theta[features] + np.concatenate([[0], np.cumsum(np.exp(theta[features + 1 :]))])
        z = np.bincount(rows, w[at] * value, n)
        error = (_sigmoid(z[:, None] - b[None]) - reached) * weight[:, None] / n
        g = np.empty_like(theta)
        g[:features] = np.bincount(at, error.sum(1)[rows] * value, features) + ridge * w
        db = -error.sum(0)
        g[features] = db.sum()
        g[features + 1 :] = np.cumsum(db[::-1])[::-1][1:] * np.exp(theta[features + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:features] * scale, theta[features] + np.concatenate([[0], np.cumsum(np.exp(theta[features + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL):
    """(vocabulary, weights, thresholds) from at most ``per_label`` rows of each label."""
    sample, toxic = labelled_sample(docs, labels, "toxic", per_label)
    vocabulary = Vocabulary(sample)
    if len(set(toxic.tolist())) < 2:
        return vocabulary, np.zeros(len(vocabulary)), np.full(GRADES - 1, 35.0)
    toxic = (toxic > 0).astype(int)
    triples = matrix(sample, vocabulary)
    grade = severity_grades(triples, toxic, len(vocabulary))
    return vocabulary, *fit_ordinal(triples, grade, len(vocabulary))


class Severity:
    """Score of one text: expected severity and the most likely grade."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def __call__(self, feature, value, text) -> tuple[float, int]:
        at_least = _sigmoid(self.weights[feature] @ value - self.thresholds)
        p = -np.diff(np.concatenate([[1.0], at_least, [0.0]]))
        return float(at_least.sum()), int(p.argmax())


def score_toxicity(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """(doc_id, text_hash, severity, grade, rejected) of every document, from its whole text."""
    vocabulary, weights, thresholds = fit_toxicity(docs, labels)
    scored = score_texts(docs, vocabulary, Severity(weights, thresholds), "severity double, grade long")
    return scored.withColumn("rejected", F.col("severity") >= reject)
