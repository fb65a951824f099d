"""Places in space for sequences: distances on the page follow distances between sequences.

A layout by stress majorisation: every pair of points has a distance that it should have, and the
places are moved, all at once, so that the sum of squared errors never grows. Wanted distances are
short along the edges, middling within a shape and long between points that nothing joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wanted distances: of points that nothing joins, and of points of one shape; an edge adds its own to ``JOINED``.
APART, TOGETHER, JOINED = 1.0, 0.4, 0.08
#: A layout compares all pairs of points and is for one drawing; more points are refused.
MOST_POINTS = 5_000


def spread(n: int) -> np.ndarray:
    """``n`` points that fill the cube around zero evenly, the same ones always: multiples, modulo
    one, of the inverse powers of the root of x^4 = x + 1."""
    root = 1.22074408460575947536
    steps = 1 / root ** np.arange(1, 4)
    return (0.5 + np.arange(1, n + 1)[:, None] * steps) % 1 - 0.5


def wanted(shape: np.ndarray, edges: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The matrix of distances that pairs should have."""
    out = np.where((shape[:, None] == shape) & (shape >= 0), TOGETHER, APART)
    if len(edges):
        a, b = edges.T
        out[a, b] = out[b, a] = JOINED + distance * APART
    np.fill_diagonal(out, 0)
    return out


def placed(shape: np.ndarray, edges: np.ndarray, distance: np.ndarray, radius: float = 100.0, steps: int = 60) -> np.ndarray:
    """Coordinates to two places of points with a ``shape`` (-1: none) and ``edges`` of a distance,
    around their middle and within ``radius``; the same for the same input."""
    n = len(shape)
    if n < 2:
        return np.zeros((n, 3))
    target, at = wanted(shape, edges, distance), spread(n)
    for _ in range(steps):
        square = (at**2).sum(axis=1)
        far = np.sqrt(np.maximum(square[:, None] + square - 2 * at @ at.T, 1e-12))
        pull = target / far
        np.fill_diagonal(pull, 0)
        at = (pull.sum(axis=1)[:, None] * at - pull @ at) / n
    at -= at.mean(axis=0)
    far = np.linalg.norm(at, axis=1).max()
    return np.round(at * (radius / far if far else 1), 2)


def layout(shapes: DataFrame, neighbours: DataFrame, key: str) -> DataFrame:
    """``(key, shape, x, y, z)`` of ``shapes(key, shape)`` and ``neighbours(src, dst, distance)``.

    A drawing is of one corpus, so its points, at most ``MOST_POINTS``, are one task; they are
    counted before they are gathered.
    """
    if shapes.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"a layout has at most {MOST_POINTS} points")
    kind = shapes.schema[key].dataType.simpleString()
    pairs = neighbours.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("distance"))
    points = shapes.select(F.lit(0).alias("g"), F.col(key).alias("a"), F.lit(None).cast(kind).alias("b"), F.col("shape").cast("double").alias("v"))
    rows = points.union(pairs.select(F.lit(1), "a", "b", "distance"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, links = frame[frame.g == 0].sort_values("a"), frame[frame.g == 1].sort_values(["a", "b"])
        number = {k: i for i, k in enumerate(nodes.a)}
        edges = np.array([[number[a], number[b]] for a, b in zip(links.a, links.b, strict=True)], int).reshape(-1, 2)
        xyz = placed(nodes.v.to_numpy().astype(int), edges, links.v.to_numpy(dtype=float))
        return pd.DataFrame({key: nodes.a.to_numpy(), "shape": nodes.v.to_numpy().astype("int64"), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return rows.groupBy().applyInPandas(draw, f"`{key}` {kind}, shape long, x double, y double, z double")
