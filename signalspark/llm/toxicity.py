"""Toxicity by compression distance.

Full zstandard dictionaries, entropy tables and content, are trained on whole windows of several
words: one on ordinary text, one on those windows of toxic text that set it apart. A text is scored
window by window. The first threshold is on a window's compressed length with the ordinary
dictionary, less that with the ordinary and the toxic content together: what two unrelated
dictionaries happen to hold of ordinary words makes no difference so. A window that reaches it is
narrowed: each of its words is compressed between two halves of a neutral window, and its own length
and its lengths with the ordinary, the joint and the toxic dictionary give its log odds, calibrated
on the labelled sample. A document's score is a logistic function of how many windows and words reach
their thresholds and by how much; it and both thresholds are fitted on the same sample.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_spread, read_table, released, text_column
from .labelled import fold, sample, texts_of

FOLDS, HELD_OUT = 5, 0
LEVEL, WINDOW = 12, 4
TOXIC_BYTES, ORDINARY_BYTES, CONTEXT_BYTES = 4_096, 16_384, 40
#: Among these are chosen the log odds that are a word's threshold, and the gain that is a window's.
THRESHOLDS, GAINS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0), (1, 2, 3, 4)
_STRIP = b".,;:!?\"'()[]#*$%&|<>-"
#: Fixed value: a dictionary's entropy tables end with its three first offsets.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def _windows(text: str | None) -> list[bytes]:
    w = (text or "").lower().encode().split()
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


def _words(window: bytes) -> list[bytes]:
    return [w for w in (x.strip(_STRIP) for x in window.split()) if w]


def _trained(size: int, samples: list[bytes], segment: int) -> tuple[bytes, bytes]:
    """Entropy tables and content of a dictionary; where the samples are too few to train on, no
    tables and the samples' own end."""
    try:
        raw = zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"", b"".join(samples)[-size:]
    at = raw.find(_OFFSETS, 8) + len(_OFFSETS)
    return (raw[:at], raw[at:]) if at >= len(_OFFSETS) else (b"", raw)


class Compressors:
    """The dictionaries (ordinary, both joined, toxic), and the lengths that windows have with them."""

    def __init__(self, tables: bytes, ordinary: bytes, toxic: bytes, most: int = 60_000):
        self.tables, self.ordinary, self.toxic = tables, ordinary, toxic
        self.context = ordinary[-CONTEXT_BYTES:]
        self._made, self._kept, self._most = None, {}, most

    def __getstate__(self):
        return {**self.__dict__, "_made": None, "_kept": {}}

    def contents(self) -> tuple[bytes, bytes, bytes]:
        """What the dictionaries hold; the toxic one ends in the neutral context as the ordinary one does."""
        return self.ordinary, self.ordinary + self.toxic, self.toxic + self.context

    def _make(self):
        made = []
        for content in self.contents():
            kind = zstandard.DICT_TYPE_FULLDICT if self.tables else zstandard.DICT_TYPE_RAWCONTENT
            data = zstandard.ZstdCompressionDict(self.tables + content, dict_type=kind) if len(content) >= 8 else None
            if data is not None:
                data.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress)
        return made

    def gain(self, window: bytes) -> int:
        """Bytes that the toxic content saves on a window."""
        made = self._made = self._made or self._make()
        return len(made[0](window)) - len(made[1](window))

    def cell(self, word: bytes) -> tuple[int, ...]:
        """Lengths of a word between two halves of a neutral window: its own up to 16, and with
        each dictionary."""
        found = self._kept.get(word)
        if found is None:
            made = self._made = self._made or self._make()
            if len(self._kept) >= self._most:
                self._kept.clear()
            window = self.context + b" " + word + b" " + self.context
            found = self._kept[word] = (min(len(word), 16), *(len(f(window)) for f in made))
        return found


class Model:
    """Compressors, the gain from which a window is narrowed, the log odds of each cell of
    lengths of a word, their threshold, and the weights of a document's features."""

    def __init__(self, compressors: Compressors, least: int, odds: dict[tuple[int, ...], float], threshold: float, weights: list[float]):
        self.compressors, self.least, self.odds, self.threshold, self.weights = compressors, least, odds, threshold, weights

    def narrowed(self, text: str | None) -> tuple[int, list[list[bytes]]]:
        """Number of windows, and the words of those whose gain reaches the threshold."""
        windows = _windows(text)
        gain, least = self.compressors.gain, self.least
        return len(windows), [_words(w) for w in windows if gain(w) >= least]

    def features(self, n: int, found: list[list[bytes]]) -> tuple[float, float, float, float]:
        """Excess of log odds a window, words over the threshold, the highest log odds, and the
        share of windows that were narrowed."""
        cell, odds, cut = self.compressors.cell, self.odds, self.threshold
        high = [v for words in found for v in (odds.get(cell(w), 0.0) for w in words) if v >= cut - 1]
        if not high:
            return 0.0, 0.0, 0.0, len(found) / max(1, n)
        excess = sum(v - cut + 1 for v in high) / n
        return math.log1p(20 * excess), math.log1p(sum(v >= cut for v in high)), max(high) / 10, len(found) / n

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, self.features(*self.narrowed(text)), strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> tuple[float, list[float]]:
    """Loss, and weights and, last, intercept of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    z = x @ w
    return float((weight * (np.logaddexp(0, z) - y * z)).sum()), w.tolist()


def _telling(toxic: list[list[bytes]], ordinary: list[list[bytes]], each: int = 5) -> set[bytes]:
    """Words that set windows of toxic text apart: a greedy cover of the toxic documents, ``each``
    times over, by words over 20 times as frequent there. Words of one family of copies cover
    its documents once and then add nothing."""
    has = [{w for x in windows for w in _words(x)} for windows in toxic]
    least, seen = max(3, 0.01 * len(toxic)), Counter(w for h in has for w in h)
    seen = {w: n for w, n in seen.items() if n >= least}
    usual: Counter = Counter()
    for windows in ordinary:
        usual.update(seen.keys() & {w for x in windows for w in _words(x)})
    where: dict[bytes, list[int]] = {w: [] for w, n in seen.items() if n * len(ordinary) > 20 * usual[w] * len(toxic)}
    for i, h in enumerate(has):
        for w in h & where.keys():
            where[w].append(i)
    need, chosen = [each] * len(toxic), set()
    while where:
        gain, word = max((sum(need[i] > 0 for i in places), w) for w, places in where.items())
        if gain < least:
            break
        chosen.add(word)
        for i in where.pop(word):
            need[i] -= 1
    return chosen


def _odds(counts: list[Counter], totals: list[int]) -> dict:
    """Log odds of each key, smoothed by half an occurrence."""
    part = lambda k, c: (counts[k][c] + 0.5 * totals[k] / totals[0]) / totals[k]
    return {c: math.log(part(1, c) / part(0, c)) for c in counts[0].keys() | counts[1].keys()}


def train(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """A model from sample texts of both labels; ``prior`` is the share of toxic labels in all."""
    texts = (ordinary, toxic)
    windows = [[_windows(t) for t in ts] for ts in texts]
    tables, base = _trained(ORDINARY_BYTES, [w for ws in windows[0] for w in ws], 64)
    telling = _telling(windows[1], windows[0])
    apart = [w for ws in windows[1] for w in ws if not telling.isdisjoint(_words(w))]
    _, content = _trained(TOXIC_BYTES, apart, 32)
    # the trainer's segments hold ordinary words around the telling ones: these are in the base already
    parts = sorted({w for w in _words(content) if w in telling})
    compressors = Compressors(tables, base, b" " + b" ".join(parts) + b" " if parts else b"")

    gains = [[[(compressors.gain(w), w) for w in ws] for ws in docs] for docs in windows]
    n = [max(1, sum(map(len, docs))) for docs in windows]
    total = len(toxic) + len(ordinary)
    best, model = math.inf, Model(compressors, GAINS[0], {}, 0.0, [0.0] * 5)
    if toxic and ordinary:
        y = np.array([0.0] * len(ordinary) + [1.0] * len(toxic))
        weight = np.where(y == 1, prior * total / len(toxic), (1 - prior) * total / len(ordinary))
        for least in GAINS:
            found = [[(len(ws), [_words(w) for d, w in ws if d >= least]) for ws in docs] for docs in gains]
            cells = [Counter(compressors.cell(w) for _, f in docs for words in f for w in words) for docs in found]
            odds = {c: v for c, v in _odds(cells, [WINDOW * k for k in n]).items() if v >= THRESHOLDS[0] - 1}
            for threshold in THRESHOLDS:
                tried = Model(compressors, least, odds, threshold, [])
                x = np.array([tried.features(*f) for docs in found for f in docs])
                loss, tried.weights = _logistic(x, y, weight)
                if loss < best:
                    best, model = loss, tried
    else:
        share = min(max(prior, 0.01), 0.99)
        model.weights = [0.0, 0.0, 0.0, 0.0, math.log(share / (1 - share))]
    return model


_models: dict[str, Model] = {}


def _loaded(raw: bytes) -> Model:
    """The model in this worker, with the windows that earlier tasks have compressed."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(raw)
    return _models[key]


def score_column(text: Column, model: Model) -> Column:
    raw = pickle.dumps(model)

    def scores(texts: list[str | None]) -> pa.Array:
        mine = _loaded(raw)
        return pa.array([mine.score(t) for t in texts], pa.float64())

    return text_column(text, "double", scores)


def fitted(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_ordinary: int = 3000) -> Model:
    """A model from the labelled documents outside the held-out fold.

    Dictionaries and calibration see at most ``most_toxic`` and ``most_ordinary`` documents, the
    bound of the sample; the share of toxic labels is counted over all. Rows with a null id or
    label are left out. Without both labels the model gives that share to every text.
    """
    known = labels.where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    toxic = texts_of(docs, sample(known.where("toxic = 1"), most_toxic, 1))
    ordinary = texts_of(docs, sample(known.where("toxic <> 1"), most_ordinary, 1))
    # the JVM's copies of the sample go before the training takes its memory beside them
    released(docs.sparkSession)
    return train(sorted(toxic), sorted(ordinary), n_toxic / n if n else 0.5)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely toxic) and ``predicted``, which replace
    any columns of those names. Whole texts are scored; null and empty ones score as a text
    without any toxic window does. Every row is scored for itself and stays."""
    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", score_column(F.col("text"), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    model = fitted(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
