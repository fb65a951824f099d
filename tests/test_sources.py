import json

import pytest

from signalspark.functions import measures, text
from signalspark.operators import segments, sequences, series
from signalspark.sources import logs, seeds


def test_a_cut_line_is_left_out(spark, tmp_path):
    event = {"slug": "a", "signal": "headline", "detected_at": "t1", "magnitude": 0.5}
    (tmp_path / "e.ndjson").write_text(json.dumps(event) + "\n" + json.dumps(event | {"detected_at": "t2"}) + '\n{"slug": "b", "sig')
    log = logs.read_lines(spark, str(tmp_path), logs.EVENT)
    assert log.count() == 2
    row = logs.retraction(log, "a", "headline", "t1", "wrong", "now")
    both = log.union(row)
    events, gone = logs.split_events(both)
    assert gone.count() == 1 and logs.retraction(both, "a", "headline", "t1", "wrong", "now") is None
    assert [r["detected_at"] for r in series.published(events, gone, logs.EVENT_KEY).collect()] == ["t2"]
    with pytest.raises(ValueError):
        logs.retraction(log, "a", "headline", "t9", "wrong", "now")
    with pytest.raises(ValueError):
        logs.retraction(log, "a", "headline", "t1", " ", "now")


def test_runs(spark):
    runs = spark.createDataFrame([("r", "x", "all", "a", "b", 1, [{"slug": "s", "yield": "3/15"}, {"slug": "t"}]), ("q", "x", "all", "a", "b", 0, [])], logs.RUN)
    assert [(r["slug"], r["found"], r["expected"]) for r in logs.results(runs).collect()] == [("s", 3, 15), ("t", 0, 0)]


def test_seeds(spark):
    rows = [("a", "A", "x", "https://a.com/", "https://a.com/p"), ("a", "B", "x", "http://b.com/?q", None), ("C!", None, "x", "https://c.com/", None)]
    frame = spark.createDataFrame(rows, "slug string, name string, segment string, homepage_url string, pricing_url string")
    found = sorted(map(tuple, seeds.faults(frame, 1, 2).collect()), key=repr)
    want = [("C!", "no name"), ("C!", "odd slug"), ("a", "homepage_url has a query or fragment"), ("a", "homepage_url is not https"), ("a", "repeated slug"), (None, "3 companies")]
    assert found == sorted(want, key=repr)
    assert [(r["slug"], r["kind"], r["host"]) for r in seeds.targets(frame).orderBy("url").collect()] == [("a", "home", "b.com"), ("a", "home", "a.com"), ("a", "pricing", "a.com"), ("C!", "home", "c.com")]


def test_known_answers(spark):
    one = spark.range(1)
    assert one.select(text.fnv1a(text.F.lit("a"))).first()[0] == "e40c292c" and one.select(text.fnv1a(text.F.lit(""))).first()[0] == "811c9dc5"
    assert one.select(text.tokens(text.F.lit("The AI-powered, go-to-market OS for teams."))).first()[0] == ["the", "powered", "market", "for", "teams"]
    assert [one.select(measures.bucket(text.F.lit(x))).first()[0] for x in (0.99, 1, 10, 100)] == ["under-1", "1-9", "10-19", "100-plus"]
    flips = lambda *x: one.select(measures.flips_to_tie(*map(text.F.lit, x))).first()[0]
    assert [flips(15, 15, 10, 12), flips(7, 10, 3, 6), flips(8, 8, 0, 9), flips(3, 6, 5, 10), flips(1, 0, 1, 2)] == [2, 2, 9, 0, None]
    prices = spark.createDataFrame([(10.0,), (30.0,)], "p double")
    assert prices.agg(measures.lower_median("p"), measures.upper_quantile("p", 0.5), measures.true_median("p")).first()[:] == (10.0, 30.0, 20.0)
    same = lambda a, b: one.select(sequences.distance(text.F.lit(a), text.F.lit(b))).first()[0]
    assert same("abc", "ab") == pytest.approx(1 / 3) and same("", "") is None


def test_cells_keep_unreadable_apart(spark):
    rows = spark.createDataFrame([("g", True)] * 4 + [("g", False)] * 2 + [("g", None)] * 3 + [("h", True), (None, True)], "grp string, a boolean")
    groups = spark.createDataFrame([("g",), ("h",), ("empty",)], "grp string")
    got = {r["group"]: (r["yes"], r["no"], r["unreadable"], r["readable"], r["share"]) for r in segments.cells(rows, "grp", {"a": text.F.col("a")}, groups).collect()}
    assert got == {"g": (4, 2, 3, 6, 66.7), "h": (1, 0, 0, 1, None), "empty": (0, 0, 0, 0, None)}
