import numpy as np

from signalspark.operators.layout import placed


def test_layout_is_steady_and_fills_its_radius():
    shape = np.array([0, 0, 0, 0, 1, 1, 1, 1, -1, -1])
    edges = np.array([[0, 1], [1, 2], [4, 5], [6, 7]])
    a, b = (placed(shape, edges, np.array([0.1, 0.2, 0.1, 0.2])) for _ in range(2))
    assert (a == b).all() and abs(np.linalg.norm(a, axis=1).max() - 100) < 0.1
    inner = lambda k: np.linalg.norm(a[shape == k] - a[shape == k].mean(axis=0), axis=1).mean()
    assert np.linalg.norm(a[:4].mean(axis=0) - a[4:8].mean(axis=0)) > max(inner(0), inner(1))
    assert placed(np.zeros(0, int), np.zeros((0, 2), int), np.zeros(0)).shape == (0, 3) and placed(np.array([-1]), np.zeros((0, 2), int), np.zeros(0)).shape == (1, 3)


def test_neighbours_are_those_of_all_pairs(spark):
    import math
    import random

    from signalspark.operators import detect, sequences

    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 14, 30])))) for i in range(90)] + [(100 + i, "abc") for i in range(9)]
    want = {}
    for i, x in rows:
        near = sorted((math.floor(detect.edit_distance(x, y) / max(len(x), len(y)) * 1000 + 0.5) / 1000, j) for j, y in rows if j != i and x and y)
        want |= {(i, n): (j, d) for n, (d, j) in enumerate(near[:6], 1)}
    found = sequences.neighbours(spark.createDataFrame(rows, "id int, sequence string"), "id").collect()
    assert {(r["src"], r["place"]): (r["dst"], r["distance"]) for r in found} == want
