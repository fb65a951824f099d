"""Scores of the two classifiers, by scorers written anew from what the models hold."""

import math
import zlib

import pytest
import zstandard

from signalspark.llm import quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def plain_toxicity(model, text):
    """One document's score, each window compressed by compressors of its own making."""
    c = model.compressors
    made = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(c.tables + x), write_content_size=False, write_dict_id=False) for x in c.contents()]
    size = lambda k, window: len(made[k].compress(window))
    words = (text or "").lower().encode().split()
    windows = [words[i : i + toxicity.WINDOW] for i in range(0, len(words), toxicity.WINDOW)]
    over, n_narrowed = [], 0
    for window in windows:
        whole = b" %b " % b" ".join(window)
        if size(0, whole) - size(1, whole) < model.least:
            continue
        n_narrowed += 1
        for w in window:
            w = w.strip(b".,;:!?\"'()[]#*$%&|<>-")
            if w:
                framed = c.context + b" " + w + b" " + c.context
                over.append(model.odds.get((min(len(w), 16), size(0, framed), size(1, framed), size(2, framed)), 0.0))
    over = [v for v in over if v >= model.threshold - 1]
    n = max(1, len(windows))
    x = [math.log1p(20 * sum(v - model.threshold + 1 for v in over) / n), math.log1p(sum(v >= model.threshold for v in over)), max(over, default=0) / 10, n_narrowed / n]
    z = sum(a * b for a, b in zip([*x, 1.0], model.weights, strict=True))
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_toxicity_scores_are_those_of_a_plain_scorer(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    found = {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in toxicity.op10_toxicity(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for d in sorted(texts)[::17]:
        score = plain_toxicity(model, texts[d])
        assert found[d] == (pytest.approx(score, abs=1e-9), int(score >= 0.5), zlib.crc32(str(d).encode()) % 5 == 0)


def test_toxicity_dictionaries_are_full_ones(spark):
    model = toxicity.fitted(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for content in model.compressors.contents():
        kept = zstandard.ZstdCompressionDict(model.compressors.tables + content, dict_type=zstandard.DICT_TYPE_FULLDICT)
        assert kept.dict_id() > 0


def plain_quality(model, text):
    """One document's score, features counted byte by byte and word by word."""
    raw = (text or "").encode()
    kind = "".join("a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) for b in raw)
    words = raw.split()
    marks = "#*$%&|<>!?.,;:\"'()[]{}/\\@_-+=~^`"
    x = [0.0] * (len(marks) + 10 + 256)
    if words:
        x[: len(marks)] = [20 * kind.count(m) / len(raw) for m in marks]
        threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        lines = [s for s in raw.split(b"\n") if s.strip()]
        x[len(marks) : len(marks) + 10] = [
            kind.count("a") / len(raw), 4 * kind.count("A") / len(raw), 10 * kind.count("0") / len(raw), len(set(words)) / len(words),
            2 * sum(threes.count(t) > 1 for t in threes) / max(1, len(words) - 2) if len(threes) < 3000 else None,
            min(len(raw) / len(words), 30) / 10, math.log(len(words)) / 5, 1 - len(set(lines)) / len(lines), min(10, len(words) / len(lines)) / 10,
            sum(s.rstrip()[-1:] in (b".", b"!", b"?", b'"') for s in lines) / len(lines),
        ]
        if x[len(marks) + 4] is None:
            return None
        for w in kind.encode().split():
            shape = b""
            for c in w:
                if not (shape and shape[-1] == c and c in b"aA0"):
                    shape += bytes([c])
            x[len(marks) + 10 + zlib.crc32(shape) % 256] += 4 / len(words)
    margin = sum(a * b for a, b in zip([*x, 1.0], model.weights, strict=True))
    z = model.slope * (margin - model.shift) + math.log(0.7 / 0.3)
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_quality_scores_are_those_of_a_plain_scorer(spark, texts):
    model = quality_classifier.fitted(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    found = {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in quality_classifier.op4_quality_classifier(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for d in sorted(texts)[::7]:
        score = plain_quality(model, texts[d])
        if score is not None:
            assert found[d] == (pytest.approx(score, abs=1e-4), found[d][1], zlib.crc32(str(d).encode()) % 4 == 2)
            assert found[d][1] == int(found[d][0] >= 0.7)


def test_quality_reads_no_label_of_a_bad_document(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, other = quality_classifier.fitted(docs, labels), quality_classifier.fitted(docs, labels.where("quality = 1"))
    assert (model.weights == other.weights).all() and (model.slope, model.shift) == (other.slope, other.shift)


def test_the_class_prior_is_found_from_positives_and_unlabelled():
    import numpy as np

    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        good, bad = rng.normal(1.5, 1, (4000, 5)), rng.normal(-1.5, 1, (2000, 5))
        n = int(2000 * prior)
        found = quality_classifier.estimated_prior(good[:2000], np.concatenate([good[2000 : 2000 + n], bad[: 2000 - n]])[rng.permutation(2000)])
        assert abs(found - prior) < 0.05


def test_toxicity_trains_after_the_drivers_garbage_is_gone(spark, sf, monkeypatch):
    order, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "released", lambda session: order.append("released"), raising=False)
    monkeypatch.setattr(toxicity, "train", lambda *a: (order.append("trained"), train([], [], 0.5))[1])
    toxicity.fitted(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert order == ["released", "trained"]
