"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled good; the rest of the evidence is unlabelled web text,
which holds good and bad. No label of a bad document is read. A linear model minimises the
non-negative unbiased risk: with class prior p and logistic loss, p * loss(positives as good)
+ max(0, loss(unlabelled as bad) - p * loss(positives as bad)). The prior is estimated from the
same two samples: a model tells positives from unlabelled text on one half of them, and on the
other half the share of unlabelled text above a margin, over that of positives, is at least p
and comes near it where hardly any bad document lies above. The threshold of the score is the
margin of least unbiased 0/1 risk. Features are shares: of character kinds, of word shapes hashed
to a fixed number of bins, and of repetition.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_spread, read_table, text_column
from .labelled import fold, sample, texts_of

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
BINS = 256
_KINDS = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"([aA0])\1+")
_MARKS = b"#*$%&|<>!?.,;:\"'()[]{}/\\@_-+=~^`"


def features(text: str | None) -> np.ndarray:
    """Shares of marks, letters' cases, digits, shapes of words and repeated words; zeros for no word."""
    out = np.zeros(len(_MARKS) + 10 + BINS, np.float32)
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return out
    kinds = raw.translate(_KINDS)
    size = len(raw)
    out[: len(_MARKS)] = [20 * kinds.count(m) / size for m in (bytes([b]) for b in _MARKS)]
    lines = [s for s in raw.split(b"\n") if s.strip()]
    starts = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = sum(c for c in starts.values() if c > 1)
    k = len(_MARKS)
    out[k : k + 10] = (
        kinds.count(b"a") / size,
        kinds.count(b"A") / size * 4,
        kinds.count(b"0") / size * 10,
        len(set(words)) / n,
        2 * repeated / max(1, n - 2),
        min(size / n, 30) / 10,
        math.log(n) / 5,
        1 - len(set(lines)) / max(1, len(lines)),
        min(10.0, n / len(lines)) / 10,
        sum(s.rstrip().endswith((b".", b"!", b"?", b'"')) for s in lines) / max(1, len(lines)),
    )
    shapes = Counter(_RUNS.sub(rb"\1", kinds).split())
    k += 10
    for shape, c in shapes.items():
        out[k + zlib.crc32(shape) % BINS] += 4 * c / n
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """Weights and, last, intercept that minimise the non-negative unbiased risk, by Adam."""
    positive, unlabelled = (np.column_stack([x, np.ones(len(x))]) for x in (positive, unlabelled))
    w = np.zeros(positive.shape[1])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p, u = _sigmoid(positive @ w), _sigmoid(unlabelled @ w)
        good = prior * -(positive.T @ (1 - p)) / len(p)
        bad = unlabelled.T @ u / len(u) - prior * (positive.T @ p) / len(p)
        risk = np.logaddexp(0, unlabelled @ w).mean() - prior * np.logaddexp(0, positive @ w).mean()
        # where the negative part of the risk is below zero it is over-fitted: step back on it
        grad = good + bad if risk >= 0 else -bad
        grad[:-1] += ridge * w[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    """Weights, and the line that maps a margin to a score of ``THRESHOLD`` at even odds."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights, slope, shift

    def margin(self, text: str | None) -> float:
        return float(features(text) @ self.weights[:-1] + self.weights[-1])

    def score(self, text: str | None) -> float:
        z = self.slope * (self.margin(text) - self.shift) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x @ weights[:-1] + weights[-1]


def _above(margins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Share of ``margins`` at or above each cut."""
    return 1 - np.searchsorted(np.sort(margins), cuts, side="left") / len(margins)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of good text in ``unlabelled``, from features of positives and unlabelled text only.

    The ratio of the shares above a margin, at the margin where its upper confidence bound is
    least; both halves take either part in turn, and their mean is taken. Under 20 texts on either
    side tell nothing, and give a half.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    found = []
    for k in (0, 1):
        w = minimise(positive[k::2], unlabelled[k::2], 0.5, rounds=200)
        p, u = _margins(positive[1 - k :: 2], w), _margins(unlabelled[1 - k :: 2], w)
        cuts = np.unique(p)
        high_p, high_u = _above(p, cuts), _above(u, cuts)
        width = math.sqrt(math.log(4 / delta) / 2 / len(u)) + math.sqrt(math.log(4 / delta) / 2 / len(p))
        at = int(np.argmin((high_u + width) / high_p))
        found.append(high_u[at] / high_p[at])
    return min(0.98, max(0.02, float(np.mean(found))))


def calibrated(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """The model whose threshold has the least unbiased 0/1 risk, the non-negative one, and of
    equally good ones the middle of the widest gap between margins."""
    p, u = _margins(positive, weights), _margins(unlabelled, weights)
    margins = np.unique(np.concatenate([p, u]))
    cuts = np.concatenate([[margins[0] - 1], (margins[1:] + margins[:-1]) / 2, [margins[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(margins), [0]])
    missed, taken = prior * (1 - _above(p, cuts)), _above(u, cuts) - prior * _above(p, cuts)
    risk = missed + np.maximum(0, taken)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    cut = float(cuts[best[np.argmax(gaps[best])]])
    low = u[u < cut]
    spread = max(1e-6, float(np.median(p) - (np.median(low) if len(low) else cut - 1)))
    return Model(weights, 8 / spread, cut)


def fitted(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model:
    """A model from trusted positives and unlabelled text, none of the held-out fold.

    At most ``most`` positives and ``most`` documents taken as unlabelled, whatever their label,
    are read: the bound of the sample. Rows with a null id or label are left out; without
    positives every text gets the threshold's score.
    """
    trusted = labels.where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & (F.col("quality") == 1)).select("doc_id")
    free = docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id")
    matrix = lambda ids: np.array([features(t) for t in sorted(texts_of(docs, ids))], np.float64).reshape(-1, len(features("")))
    positive, unlabelled = matrix(sample(trusted, most, 1)), matrix(sample(free, most, 2))
    return trained(positive, unlabelled)


def trained(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model from the features of both samples."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(len(features("")) + 1), 1.0, 0.0)
    prior = estimated_prior(positive, unlabelled)
    return calibrated(minimise(positive, unlabelled, prior), positive, unlabelled, prior)


def score_column(text: Column, model: Model) -> Column:
    return text_column(text, "double", lambda texts: pa.array([model.score(t) for t in texts], pa.float64()))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely good) and ``predicted`` (score at least
    0.7), which replace any columns of those names. Whole texts are scored; null and empty ones
    have features of zero. Every row is scored for itself and stays."""
    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", score_column(F.col("text"), model)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    model = fitted(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
