"""Positions, quantiles, first names and as-of values against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from signalspark.operators import insights, ordering, readmodels, series


def rows_of(seed, n=400):
    """A third of all rows in one group, half of these with one value, and nulls on both sides."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([7, 7, 7, None, rng.randrange(40), rng.randrange(-5, 5)]), i) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([*rows_of(1), ("empty", None, 999)], "g string, v int, i int").repartition(5).cache()


def test_ranks_with_ties(spark, frame):
    rows = [tuple(r) for r in frame.collect()]
    for by in ((), ("g",)):
        got = {r["i"]: (r["place"], r["ties"]) for r in ordering.ranked(frame, "v", *by).collect()}
        assert len(got) == len(rows)
        for g, v, i in rows:
            peers = [x[1] for x in rows if not by or x[0] == g]
            above = sum(1 for x in peers if x is not None and (v is None or x > v))
            assert got[i] == (above + 1, peers.count(v) - 1)


def test_quantiles_are_exact(spark, frame):
    rows = [tuple(r) for r in frame.collect()]
    parts = {"q0": 0.0, "p25": 0.25, "mid": 0.5, "p90": 0.9, "q1": 1.0}
    got = {r["g"]: r for r in ordering.quantiles(frame, "v", parts, "g").collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        v = sorted(x[1] for x in rows if x[0] == g and x[1] is not None)
        assert r["n"] == len(v) and (r["least"], r["greatest"]) == ((v[0], v[-1]) if v else (None, None))
        assert all(r[name] == (v[min(len(v) - 1, int(q * len(v)))] if v else None) for name, q in parts.items())
    whole = ordering.quantiles(frame.where("v is null"), "v", parts).collect()
    assert len(whole) == 1 and whole[0]["n"] == 0 and whole[0]["mid"] is None


@pytest.mark.parametrize("hot", [False, True])
def test_hot_keys_are_joined_apart(spark, hot):
    n = 3000 if hot else 30
    rows = spark.range(n).select((F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2)).alias("k"), "id")
    unique = rows.groupBy("k").agg(F.count("*").alias("n")).cache()
    got = ordering.join_unique(rows, unique, ["k"], "n").collect()
    assert len(got) == n and all(r["n"] == {None: n // 3}.get(r["k"], n // 3) for r in got)


def test_first_names(spark, frame):
    rows = [tuple(r) for r in frame.collect()]
    got = {r["g"]: r["first"] for r in ordering.first_of(frame, ["g"], "i", ["i"], 3).collect()}
    assert got == {g: sorted(r[2] for r in rows if r[0] == g)[:3] for g in {r[0] for r in rows}}
    shown = insights.coverage(frame, F.col("v"), F.lit(0), F.lit(0), F.col("i").cast("string"), "g", most=2).collect()
    full = {r["g"]: r for r in insights.coverage(frame, F.col("v"), F.lit(0), F.lit(0), F.col("i").cast("string"), "g").collect()}
    assert len(shown) == len(full) and all(r["missing"] == full[r["g"]]["missing"][:2] and r["unreadable"] == full[r["g"]]["unreadable"] for r in shown)


def test_as_of_values(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    right = [(key(), rng.choice([None, *range(50)]), rng.randrange(5)) for _ in range(300)]
    left = [(key(), rng.choice([None, *range(60)]), i) for i in range(300)]
    one = spark.createDataFrame(left, "k string, t int, i int").repartition(4)
    two = spark.createDataFrame(right, "k string, at int, v int").repartition(3)
    for within in (None, 3):
        got = {r["i"]: r["found"] for r in ordering.as_of(one, two, ["k"], "t", "at", None if within is None else F.lit(within)).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            able = [(at, v) for kk, at, v in right if k is not None and kk == k and at is not None and t is not None and at <= t and (within is None or at >= t - within)]
            best = max(able, default=None)
            assert (None if got[i] is None else (got[i]["at"], got[i]["v"])) == best
    assert ordering.as_of(one, two.limit(0), ["k"], "t", "at").where("found is not null").count() == 0
    assert ordering.as_of(one.limit(0), two, ["k"], "t", "at").count() == 0


def test_as_of_keeps_a_row_a_row(spark):
    """States times reads of one page would be 4,000,000 rows; repeated states stay."""
    states = spark.range(2000).select(F.lit("p").alias("k"), F.col("id").alias("t"), F.lit(0).cast("long").alias("good")).union(spark.sql("select 'p', 5L, 0L"))
    reads = spark.range(2000).select(F.lit("p").alias("k"), (F.col("id") * 2).alias("at"), F.lit("ok").alias("status"))
    got = sorted((r["t"], r["good"]) for r in readmodels.carried_good(states, reads, ["k"], "good", "t").collect())
    assert got == sorted([(t, t - t % 2) for t in range(2000)] + [(5, 4)])


def test_messages_name_three(spark):
    results = spark.createDataFrame([("r", "ok")] * 9 + [("s", "ok")], "run string, status string")
    movers = spark.createDataFrame([("r", f"c{i}") for i in (5, 3, 1, 2, 4)] + [("r", None)], "run string, name string")
    got = {r["run"]: r["message"] for r in series.run_messages(results, movers, "run", "status", "name", ("ok",), "co ").collect()}
    assert got == {"r": "9 targets; co c1, co c2, co c3 +2 more; 9 ok", "s": "1 targets; 1 ok"}
