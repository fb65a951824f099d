"""Nearest sequences against all pairs, and how few pairs are tried."""

import random

import pytest
from pyspark.sql import functions as F

from signalspark.operators import sequences as S


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def far(a, b):
    return int(edits(a, b) / max(len(a), len(b)) * 1000 + 0.5) / 1000


def families(seed, n, letters="abcdefghijklmnopq", sizes=(1, 12, 20)):
    """Sequences in families of few edits, and some that stand alone."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [rng.choice(letters) for _ in range(rng.randrange(1, 16))]
        for _ in range(rng.choice(sizes)):
            one = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(one) + 1)
                one[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
            out.append("".join(one))
    return out[:n]


@pytest.mark.parametrize("seed, letters", [(1, "abcdefghijklmnopq"), (2, "ab"), (3, "a")])
def test_neighbours_are_those_of_all_pairs(spark, seed, letters):
    rows = list(enumerate(families(seed, 90, letters)))
    frame = spark.createDataFrame(rows, "key int, sequence string")
    got = sorted(tuple(r) for r in S.neighbours(frame, "key", 4).collect())
    want = []
    for i, a in rows:
        near = sorted((far(a, b), j) for j, b in rows if j != i and a and b)[:4] if a else []
        want += [(i, j, d, k + 1) for k, (d, j) in enumerate(near)]
    assert got == sorted(want)


@pytest.mark.parametrize("tau", [1, 2, 3, 4, 8])
def test_candidates_lose_no_pair(spark, tau):
    names = sorted({s for s in families(tau, 120, "abcd") if s})
    known = spark.createDataFrame([(s, len(s)) for s in names], "y string, m int")
    got = {tuple(r) for r in S.candidates(known.select(F.col("y").alias("x"), F.col("m").alias("n")), known, tau, max(map(len, names))).collect()}
    assert not {(a, b) for a in names for b in names if edits(a, b) <= tau} - got


def test_few_pairs_are_tried(spark):
    """Of sequences in families all rounds together try a small part of all pairs; one in eleven families
    is a sequence that stands alone, and is held against all."""
    names = sorted({s for s in families(9, 6000, sizes=[1, *[40] * 10]) if len(s) > 7})
    members = spark.createDataFrame([(s, 1) for s in names], "sequence string, size long")
    tried = []
    real = S.candidates

    def counted(left, known, tau, longest):
        out = real(left, known, tau, longest)
        tried.append((tau, left.count(), out.count()))
        return out

    S.candidates = counted
    try:
        S.nearest_sequences(members, 6).count()
    finally:
        S.candidates = real
    assert len(names) > 1500 and tried[0][2] < len(names) ** 2 / 100
    assert sum(n for _, _, n in tried) < len(names) ** 2 / 10, tried


def test_the_last_label_of_a_key_holds(spark):
    truth = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1)], "k int, label string, at int")
    predicted = spark.createDataFrame([(1, "b"), (2, "b"), (3, "b")], "k int, label string")
    assert tuple(S.scored(predicted, truth, ["k"], "label", "none", "at").first()) == (2, 2, 2, 2)
    assert tuple(S.scored(predicted, truth.withColumn("at", -F.col("at")), ["k"], "label", "none", "at").first()) == (2, 1, 2, 1)
