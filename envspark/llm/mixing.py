"""Mixing sources to target weights with soft membership.

A classifier fitted on the labelled table (documents listed in ``labels`` whose domain is known)
gives every document posterior probabilities p_d over the domains.  Nonnegative document rates r_i
are then fitted so that the expected token totals A_d = sum_i r_i n_i p_id match the targets T_d:
projected gradient on the least-squares loss sum_d (A_d - T_d)^2 / N_d, N_d being the totals at
rate 1.  One round is one aggregate of as many numbers as there are domains; a document's rate
follows from the gradients of all rounds, so no state is kept besides the posteriors.

Cases: null and empty texts have no tokens, the posteriors of an empty text and a rate like any
other; null domains teach nothing; without labelled rows all domains of the targets are equally
likely; a target domain that no document belongs to is left unmet; repeated rows have one rate;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .sparse import Vocabulary, labelled_sample, matrix, score_texts

#: Target shares of the expected tokens.
WEIGHTS = {"en": 0.52, "de": 0.17, "fr": 0.17, "es": 0.14}
#: Labelled rows used for fitting: at most so many of each domain.
PER_DOMAIN = 1000
ROUNDS = 40
#: Room above the least total, so that documents of several domains keep a rate of 1 or more as well.
MARGIN = 1.02


def fit_softmax(triples, y: np.ndarray, classes: int, features: int, steps: int = 120, ridge: float = 1e-4) -> np.ndarray:
    """(features + 1) x classes weights of a softmax regression, the last row being intercepts."""
    rows, at, value = triples
    n = len(y)
    w, m, v = (np.zeros((features + 1, classes)) for _ in range(3))
    truth = np.eye(classes)[y]
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(rows, w[at, k] * value, n) for k in range(classes)], 1) + w[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - truth) / n
        g = ridge * w
        g[:-1] += np.stack([np.bincount(at, error[rows, k] * value, features) for k in range(classes)], 1)
        g[-1] += error.sum(0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


class Posterior:
    """Score of one text: its words and the posterior of each domain."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __call__(self, feature, value, text) -> tuple[int, list[float]]:
        z = value @ self.weights[feature] + self.weights[-1]
        p = np.exp(z - z.max())
        return len(text.split()), (p / p.sum()).tolist()


def memberships(docs: DataFrame, labels: DataFrame, domain: str, domains: list[str], per_domain: int = PER_DOMAIN) -> DataFrame:
    """(doc_id, text_hash, n_tokens, p array<double>) of every document; ``domain`` is a column of ``labels``."""
    known = labels.where(F.col(domain).isin(domains)).select("doc_id", F.array_position(F.array(*map(F.lit, domains)), F.col(domain)).alias("k"))
    sample, k = labelled_sample(docs, known, "k", per_domain)
    vocabulary = Vocabulary(sample)
    weights = np.zeros((len(vocabulary) + 1, len(domains)))
    if len(sample):
        weights = fit_softmax(matrix(sample, vocabulary), k.astype(int) - 1, len(domains), len(vocabulary))
    return score_texts(docs, vocabulary, Posterior(weights), "n_tokens long, p array<double>")


def rate(history: list[list[float]]) -> Column:
    """The rate after the rounds of ``history``: from 1, a step against each gradient, projected to >= 0."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in history])
    dot = lambda g: F.aggregate(F.zip_with("p", g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_rates(members: DataFrame, shares: list[float], rounds: int = ROUNDS) -> DataFrame:
    """``members`` (doc_id, text_hash, n_tokens, p) with ``rate``.  The targets are ``shares`` of the total that
    gives the most plentiful domain, compared with its target, the rate 1: other domains are
    repeated up to their share and nothing has to be thrown away."""
    totals = lambda h: [float(x or 0) for x in members.select("n_tokens", "p", rate(h).alias("r")).agg(*[F.sum(F.col("r") * F.col("n_tokens") * F.col("p")[d]) for d in range(len(shares))]).first()]
    at_one = totals([])
    whole = MARGIN * max([a / s for a, s in zip(at_one, shares) if s > 0], default=0.0)
    target = [whole * s for s in shares]
    history: list[list[float]] = []
    for _ in range(rounds):
        now = totals(history)
        step = [(a - t) / n if n else 0.0 for a, t, n in zip(now, target, at_one)]
        history.append(step)
        if all(abs(a - t) <= 1e-4 * max(t, 1.0) for a, t, n in zip(now, target, at_one) if n):
            break
    return members.withColumn("rate", rate(history))


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(doc_id, text_hash, n_tokens, p, rate, copies) of every document; ``copies`` is the rate rounded up or
    down by a hash of the id, so that expected copies equal the rate."""
    total = sum(weights.values())
    members = store(memberships(docs, labels, domain, list(weights)), "members")
    rated = fit_rates(members, [w / total for w in weights.values()])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
