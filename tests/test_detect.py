import json

import pytest

from signalspark.operators import detect as D
from signalspark.streaming.detect import append_once, detect_stream, read_log


def read(value, confidence=1.0, method="h1", raw=None):
    return None if value is None else {"value": value, "method": method, "confidence": confidence, "json": raw}


def run(name, readings, origins=None):
    """Outcomes and events of readings of one signal on a healthy page."""
    state, outcomes, events = None, [], []
    for i, r in enumerate(readings):
        o = origins[i] if origins else (False, "x:DE")
        state, outcome, event = D.step_signal(name, r, state, f"t{i}", True, *o)
        outcomes.append(outcome)
        events += [event] if event else []
    return outcomes, events, state


def test_first_reading_publishes_nothing():
    assert run("headline", [read("a b")])[0] == ["baseline"]
    assert run("headline", [None])[0] == ["baseline-empty"]
    assert run("headline", [None, None])[0] == ["baseline-empty", "no-data"]


def test_absence_is_a_fault_until_five_reads():
    outcomes, events, state = run("headline", [read("a b")] + [None] * 5)
    assert outcomes == ["baseline"] + ["parser-fault"] * 4 + ["confirmed-removal"]
    assert [e["change_type"] for e in events] == ["removed"] and state["value"] is None and state["suspect"] == 0 and state["changes"] == 1
    state = D.step_signal("headline", read("a"), None, "t")[0]
    for _ in range(9):
        state, outcome, event = D.step_signal("headline", None, state, "t", healthy=False)
        assert (outcome, event) == ("parser-fault", None)
    assert state["suspect"] == 1


def test_a_value_that_appears_is_adopted_in_silence():
    outcomes, events, state = run("headline", [None] + [read("a b")] * 4)
    assert outcomes == ["baseline-empty", "acquisition", "acquisition", "acquisition-adopted", "unchanged"] and not events and state["value"] == "a b"
    assert run("headline", [None, read("a"), read("b"), read("b")])[0][1:] == ["acquisition"] * 3


def test_typography_is_no_change_and_case_is():
    outcomes, events, _ = run("headline", [read("It's “new” – now"), read("It’s \"new\" -  now"), read("it's \"new\" - now")])
    assert outcomes == ["baseline", "unchanged", "changed"] and events[0]["magnitude"] == round(1 / 16, 3)


def test_values_that_return_oscillate():
    _, events, state = run("headline", [read("A"), read("B"), read("A")] + [read(f"v{i}") for i in range(18)])
    assert [e["oscillating"] for e in events[:2]] == [0, 1] and len(state["recent"]) == 6


def test_weaker_method_is_suppressed():
    outcomes, _, state = run("headline", [read("A a"), read("B b", 0.4, "og")])
    assert outcomes[-1] == "suppressed" and state["value"] == "A a" and state["suspect"] == 1
    assert run("headline", [read("A a"), read("B b", 0.4, "h1")])[0][-1] == "changed"


def test_lists():
    names = [f"n{i}" for i in range(10)]
    wall = lambda k: read(" | ".join(names[:k]), raw=json.dumps({"names": names[:k]}))
    assert run("customer_logos", [wall(10), wall(3)])[0][-1] == "suppressed"
    outcomes, events, _ = run("customer_logos", [wall(10), wall(4)])
    assert outcomes[-1] == "changed" and events[0]["removed"] == names[4:] and events[0]["magnitude"] == 0.6


def test_currencies():
    eur, usd, dear = (read(v) for v in ("EUR 9.5", "USD 10", "USD 30"))
    assert run("pricing_entry_price", [eur, usd, usd, usd])[0] == ["baseline", "currency-shift", "currency-shift", "currency-rebaselined"]
    assert run("pricing_entry_price", [eur, dear])[0][-1] == "changed"
    assert run("pricing_entry_price", [eur, usd], [(False, "a"), (True, "b")])[0][-1] == "origin-shift"
    assert run("headline", [read("from $5"), read("from €5")], [(False, "a"), (True, "b")])[0][-1] == "origin-shift"
    assert run("headline", [read("plain"), read("other")], [(False, "a"), (True, "b")])[0][-1] == "changed"


def page(i, **more):
    signals = {n: read(f"{n} one") for n, (_, family, _) in D.SIGNALS.items() if family in ("hero", "proof")}
    return {"at": f"2026-01-{i:02d}", "fetch_ok": True, "extractable": True, "variant": "html", "extractor_version": "1", "lang": "en", "canonical": "u", "origin": {"environment": "ci", "country": "US", "id": "ci:US"}, "signals": signals} | more


@pytest.mark.parametrize(
    "more, status, open_, rebaseline",
    [
        ({"fetch_ok": False}, "error", False, False),
        ({"extractable": False}, "blocked", False, False),
        ({"extractor_version": "2"}, "ok", False, True),
        ({"variant": "json"}, "changed-structure", False, True),
        ({"lang": "de"}, "ok", False, True),
        ({"lang": None}, "ok", True, False),
        ({"canonical": "v"}, "ok", False, True),
        ({"origin": {"environment": "ci", "country": "DE"}}, "origin-shift", True, False),
        ({"origin": {"environment": "unknown"}}, "ok", True, False),
    ],
)
def test_gate(more, status, open_, rebaseline):
    state = D.step(None, page(1))[0]
    g = D.gate(page(2, **more), state)
    assert (g["status"], g["open"], g["rebaseline"]) == (status, open_, rebaseline)


def test_a_fallen_family_closes_the_page():
    state = D.step(None, page(1))[0]
    broken = page(2)
    for n in ("headline", "subhead", "category_label"):
        broken["signals"][n] = None
    new, outcomes, events, g = D.step(state, broken)
    assert g["status"] == "changed-structure" and set(outcomes.values()) == {"suppressed"} and not events
    assert new["state"]["headline"]["nulls"] == 0 and new["state"]["headline"]["value"] == "headline one"


def test_unchanged_fetches_corroborate():
    state = D.step(None, page(1, signals={"headline": None, "subhead": read("s")}))[0]
    later = {"headline": read("h"), "subhead": read("s")}
    state = D.step(state, page(2, signals=later))[0]
    state = D.corroborated(state, later, "t")
    state = D.corroborated(state, later, "t")
    assert state["state"]["headline"]["value"] == "h" and D.corroborated(state, later, "t") is None


def observations():
    days = []
    for i in range(1, 8):
        signals = {"headline": read("same" if i < 3 else "other words"), "subhead": read(None if i > 2 else "here"), "meta_title": read("t"), "meta_description": read("d")}
        for slug in ("a", "b"):
            days.append((slug, "home", i, json.dumps(page(i, signals=signals))))
    return days


def test_stream_is_batch(spark, tmp_path):
    schema = "slug string, kind string, seq long, observation string"
    rows = observations()
    want = sorted(map(tuple, D.detect(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert {r[6] for r in want} == {"baseline", "unchanged", "changed", "parser-fault", "confirmed-removal"}
    for i in range(1, 8):
        spark.createDataFrame([r for r in rows if r[2] == i], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = detect_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in")))
    log = str(tmp_path / "log")

    def sink(frame, _):
        append_once(frame, log, ["slug", "kind", "seq", "signal"])
        assert append_once(frame, log, ["slug", "kind", "seq", "signal"]) == 0

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, read_log(spark, log).collect()), key=repr) == want


def test_a_page_that_falls_as_a_whole_is_closed():
    small = {n: read("x") for n in ("headline", "subhead", "proof_points", "customer_logos")}
    state = D.step(None, page(1, signals=small))[0]
    g = D.gate(page(2, signals=small | {n: None for n in ("headline", "subhead", "proof_points")}), state)
    assert g["status"] == "changed-structure" and "page 4 -> 1" in g["reason"]
    assert D.gate(page(2, signals=small | {"headline": None}), state)["status"] == "ok"


def test_unchanged_reads_move_acquisitions_on_in_the_fold(spark):
    full = {n: read(n) for n, (_, family, _) in D.SIGNALS.items() if family == "hero"}
    rows = [page(1, signals=full | {"headline": None}), page(2, signals=full), {"at": "2026-01-03", "status": "unchanged"}, {"at": "2026-01-04", "status": "unchanged"}, {"at": "2026-01-05", "status": "unchanged"}]
    frame = spark.createDataFrame([("a", "home", i, json.dumps(r)) for i, r in enumerate(rows)], "slug string, kind string, seq long, observation string")
    found = [(r["seq"], r["outcome"]) for r in D.detect(frame).orderBy("seq").collect() if r["signal"] == "headline"]
    assert found == [(0, "baseline-empty"), (1, "acquisition"), (2, "acquisition"), (3, "acquisition-adopted")]


def test_summaries():
    _, events, _ = run("headline", [read("A"), read("B" * 200), read("A")])
    assert D.summary("headline", events[0]).startswith('headline changed from "A" to "BBB') and len(D.summary("headline", events[0])) < 130
    assert D.summary("headline", events[1]).endswith("a value that it had before")
    names = [f"n{i}" for i in range(10)]
    _, events, _ = run("customer_logos", [read(" | ".join(names[:k]), raw=json.dumps({"names": names[:k]})) for k in (10, 5)])
    assert D.summary("customer_logos", events[0]) == "customer logos removed n5, n6, n7 and 2 more"
    gone = run("headline", [read("a b")] + [None] * 5)[1][0]
    assert D.summary("headline", gone) == 'headline is gone; it was "a b"'
    state = D.step(None, page(1))[0]
    state = D.step(state, page(2, signals=page(2)["signals"] | {"headline": None}))[0]
    assert D.step(state, page(3))[3]["evidence"] == ["another signal was missing at the last read"]


def test_edit_distances():
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert D.edit_distance(a, b) == plain(a, b)


def test_appends_take_whole_batches_only(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1)], "k long, v string, n long")
    assert append_once(rows, log, ["k"], "n") == 2 and append_once(rows, log, ["k"]) == 0
    assert sorted(map(tuple, read_log(spark, log).collect())) == [(1, "a", 1), (2, "c", 1)]
    rows.write.parquet(f"{log}/_writing-x")  # a write that was cut short
    assert read_log(spark, log).count() == 2 and read_log(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):
        append_once(rows.withColumnRenamed("k", "other"), log, ["other"])


BAD = [None, "", "{", "[]", "3", '{"signals": {}}', '{"at": 3, "signals": {}}', '{"at": "t", "signals": []}', '{"at": "t", "signals": {"headline": 3}}', '{"at": "t", "signals": {"headline": {"value": 3}}}', '{"at": "t", "origin": "x"}', '{"at": "t", "signals": {"headline": {"value": "a", "confidence": "high"}}}', "[" * 100_000]


def test_rows_that_cannot_be_read_carry_the_state(spark):
    """Broken rows between good ones give *unreadable*, and the good ones the same outcomes as without them."""
    good = [r for r in observations() if r[0] == observations()[0][0]]
    schema = "slug string, kind string, seq long, observation string"
    mixed = [(s, k, 100 * n, o) for s, k, n, o in good] + [(good[0][0], good[0][1], 100 + i, b) for i, b in enumerate(BAD)]
    rows = D.detect(spark.createDataFrame(mixed, schema)).collect()
    bad = [r for r in rows if r["outcome"] == "unreadable"]
    assert len(bad) == len(BAD) and all(r["signal"] is None and r["status"] == "unreadable" for r in bad)
    want = D.detect(spark.createDataFrame([(s, k, 100 * n, o) for s, k, n, o in good], schema)).collect()
    assert sorted((r for r in rows if r["outcome"] != "unreadable"), key=repr) == sorted(want, key=repr)


def test_signals_that_are_not_known_are_left_out():
    observed = json.dumps(page(1, signals={"headline": read("x"), "shoe_size": read("44")}))
    out, state = D.outcome_rows(("s", "home"), [{"seq": 1, "observation": observed}], None)
    assert {(r[5], r[6]) for r in out} == {("headline", "baseline"), ("shoe_size", "unreadable")} and set(state["state"]) == {"headline"}


def test_a_value_that_appears_tells_what_speaks_for_a_broken_read_before():
    full = {n: read("v " + n) for n in ("headline", "subhead", "meta_title", "customer_logos", "proof_points")}
    rows = lambda *signals: [{"seq": i, "observation": json.dumps(page(i, signals=full | s))} for i, s in enumerate(signals)]
    told = lambda *signals: [r[12] for r in D.outcome_rows(("s", "home"), rows(*signals), None)[0] if r[5] == "subhead" and r[6].startswith("acquisition")]
    assert told({"subhead": None}, {}) == [None]
    assert told({"subhead": None}, {"subhead": None, "headline": None}, {}) == ["another signal was missing at the last read"]
    assert told({"subhead": None}, {n: None for n in full}, {})[0].startswith("the page's structure had changed at the last read; the last read found 0 signals, this one 5")
