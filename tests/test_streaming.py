"""The commit log, the fold over it, the keyed stream, and growing files."""

import json
import random
import threading

import pytest

from signalspark.operators import detect as D
from signalspark.sources import tail
from signalspark.streaming import keyed
from signalspark.streaming.commitlog import CommitLog, Conflict
from signalspark.streaming.fold import DetectorLog, fold

ROWS = "k long, v string"
SCHEMA = "slug string, kind string, seq long, observation string"


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, ROWS)


def table(log):
    frame = log.read()
    return sorted(map(tuple, frame.collect()), key=repr) if frame is not None else []


# commit log --------------------------------------------------------------------------------------


def test_keys_are_appended_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.read() is None and log.version() == -1
    assert log.append(rows_of(spark, (1, "b"), (1, "a"), (None, "x"), (None, "y")), ["k"], "v") == 2
    assert log.append(rows_of(spark, (1, "c"), (2, "d"), (None, "z")), ["k"]) == 1
    assert log.append(rows_of(spark, (2, "e")), ["k"]) == 0 and log.version() == 1
    assert table(log) == [(1, "a"), (2, "d"), (None, "x")]
    assert sorted(map(tuple, log.read(after=0).collect())) == [(2, "d")] and sorted(map(tuple, log.read(upto=0).collect()), key=repr) == [(1, "a"), (None, "x")]
    with pytest.raises(ValueError, match="not of"):
        log.append(spark.createDataFrame([(1,)], "k long"), ["k"])


def test_a_batch_counts_once_a_writer(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    for writer, batch, n in (("a", 1, 1), ("a", 1, 0), ("b", 1, 1), ("a", 2, 1), ("a", 2, 0)):
        assert log.append(rows_of(spark, (1, "same")), writer=writer, batch=batch) == n
    assert len(table(log)) == 3


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path))
    log.append(rows_of(spark, (1, "a")), ["k"], writer="w", batch=1)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "_commit", lambda self, entry: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.append(rows_of(spark, (2, "b")), ["k"], writer="w", batch=2)
    assert table(log) == [(1, "a")] and len(list((tmp_path / "data").iterdir())) == 2
    assert log.append(rows_of(spark, (2, "b")), ["k"], writer="w", batch=2) == 1 and table(log) == [(1, "a"), (2, "b")]
    assert log.vacuum(0) == 1 and table(log) == [(1, "a"), (2, "b")]


def test_a_crash_after_the_commit_is_found_out(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path))
    commit = CommitLog._commit

    def lost(self, entry):
        commit(self, entry)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "_commit", lost)
        with pytest.raises(OSError):
            log.append(rows_of(spark, (1, "a")), writer="w", batch=1)
    assert log.append(rows_of(spark, (1, "a")), writer="w", batch=1) == 0 and table(log) == [(1, "a")]


def test_the_loser_of_a_race_takes_out_what_the_winner_has(spark, tmp_path, monkeypatch):
    """The other writer commits between this one's look at the log and its commit."""
    mine, other = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    commit, raced = CommitLog._commit, []

    def slow(self, entry):
        if self is mine and not raced:
            raced.append(other.append(rows_of(spark, (1, "theirs"), (3, "theirs")), ["k"]))
        return commit(self, entry)

    monkeypatch.setattr(CommitLog, "_commit", slow)
    assert mine.append(rows_of(spark, (1, "mine"), (2, "mine")), ["k"]) == 1 and raced == [2]
    assert table(mine) == [(1, "theirs"), (2, "mine"), (3, "theirs")]


def test_writers_at_once(spark, tmp_path):
    done, failed = [], []

    def write(name):
        try:
            log = CommitLog(spark, str(tmp_path))
            for i in range(4):
                done.append(log.append(rows_of(spark, *((i * 3 + j, name) for j in range(6))), ["k"], writer=name, batch=i))
        except Exception as error:  # shown by the assertion below
            failed.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    log = CommitLog(spark, str(tmp_path))
    assert sorted(r[0] for r in table(log)) == list(range(15)) and sum(done) == 15
    versions = [e["version"] for e in log.entries()]
    assert versions == list(range(len(versions)))


def test_commits_are_summed_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("signalspark.streaming.commitlog.SUMMARY", 3)
    log = CommitLog(spark, str(tmp_path))
    for i in range(8):
        log.append(rows_of(spark, (i, "x")), ["k"], writer="w", batch=i)
    read = []
    monkeypatch.setattr(CommitLog, "_text", lambda self, name, f=CommitLog._text: read.append(name) or f(self, name))
    assert [e["batch"] for e in log.entries()] == list(range(8)) and len(read) == 3
    assert log.append(rows_of(spark, (0, "x")), writer="w", batch=0) == 0


def test_only_folders_that_may_have_a_key_are_read(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path))
    for i in range(5):
        log.append(rows_of(spark, *((10 * i + j, "x") for j in range(5))), ["k"])
    seen = []
    monkeypatch.setattr(CommitLog, "_without", lambda self, folder, keys, known, f=CommitLog._without: seen.append(len(known)) or f(self, folder, keys, known))
    assert log.append(rows_of(spark, (21, "y"), (25, "y")), ["k"]) == 1 and seen == [1]
    assert log.append(rows_of(spark, (99, "y")), ["k"]) == 1 and seen == [1, 0]
    assert CommitLog.overlap({"k": ["b", "d", False]}, {"k": ["e", "f", True]}) is False and CommitLog.overlap({"k": [None, None, True]}, {"k": [1, 2, True]}) is True


def test_compaction(spark, tmp_path, monkeypatch):
    log, other = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    for i in range(3):
        log.append(rows_of(spark, (i, "x")), ["k"])
    commit, raced = CommitLog._commit, []

    def slow(self, entry):
        if self is log and entry["replaces"] and not raced:
            raced.append(other.append(rows_of(spark, (7, "late")), ["k"]))
        return commit(self, entry)

    monkeypatch.setattr(CommitLog, "_commit", slow)
    assert log.compact() == 3 and raced == [1]
    assert table(log) == [(0, "x"), (1, "x"), (2, "x"), (7, "late")] and len(log.live(log.entries())) == 2
    assert log.append(rows_of(spark, (1, "again")), ["k"]) == 0 and log.read(after=2).count() == 1
    assert log.vacuum(0) == 3 and len(table(log)) == 4

    def twice(self, entry):
        if self is log and entry["replaces"] and len(raced) == 1:
            raced.append(other.compact())
        return commit(self, entry)

    monkeypatch.setattr(CommitLog, "_commit", twice)
    with pytest.raises(Conflict):
        log.compact()
    assert len(table(log)) == 4


# fold --------------------------------------------------------------------------------------------


def signal(value, confidence=1.0):
    return None if value is None else {"value": value, "method": "h1", "confidence": confidence, "json": None}


def history(seed, pages=6, reads=12):
    """Random readings: repeated, changed and missing values, failures, unchanged fetches, new extractors, broken rows."""
    rng = random.Random(seed)
    out = []
    for p in range(pages):
        held = {n: rng.choice([None, f"{n} {rng.randrange(9)}"]) for n in ("headline", "subhead", "meta_title", "customer_logos", "pricing_entry_price")}
        for seq in range(reads):
            kind = rng.random()
            at = f"2026-01-{seq + 1:02d}T00:00:00"
            if kind < 0.05:
                out.append((f"p{p}", "home", seq, rng.choice(["{", None, '{"at": 1}'])))
                continue
            if kind < 0.3:
                name = rng.choice(list(held))
                held[name] = rng.choice([None, f"{name} {rng.randrange(9)}", "EUR 10", "$ 10"])
            observed = {"at": at, "fetch_ok": kind > 0.1, "extractable": True, "variant": "html", "extractor_version": "2" if kind > 0.97 else "1", "lang": "en", "signals": {n: signal(v) for n, v in held.items()}}
            if 0.3 < kind < 0.4:
                observed = {"at": at, "status": "unchanged"}
            out.append((f"p{p}", "home", seq, json.dumps(observed)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def outcomes(frame_):
    return sorted((tuple(r)[:13] for r in frame_.collect()), key=repr)


def states_of(frame_):
    return {(r["slug"], r["kind"]): json.loads(r["page"]) for r in frame_.where("page is not null").collect()}


def test_a_fold_of_tails_is_the_whole_fold(spark, tmp_path):
    rows = history(1)
    want, whole = outcomes(D.detect(frame(spark, rows))), states_of(fold(frame(spark, rows)))
    log = DetectorLog(spark, str(tmp_path / "observations"), str(tmp_path / "detector"))
    assert log.advance() == 0
    for a, b in ((0, 4), (4, 5), (5, 12)):
        log.observations.append(frame(spark, [r for r in rows if a <= r[2] < b]), writer="crawl", batch=a)
        assert log.advance() > 0 and log.advance() == 0
    assert outcomes(log.outcomes.read()) == want
    from signalspark.streaming.fold import latest

    assert states_of(latest(log.states.read())) == whole
    assert log.compact(2) == 3 and states_of(log.states.read()) == whole and log.compact(2) == 0
    assert log.advance() == 0


def test_a_tail_reads_no_old_observations(spark, tmp_path, monkeypatch):
    log = DetectorLog(spark, str(tmp_path / "observations"), str(tmp_path / "detector"))
    rows = history(2, pages=3)
    log.observations.append(frame(spark, rows[:-3]))
    log.advance()
    log.observations.append(frame(spark, [("p0", "home", 50, rows[0][3]), ("new", "home", 51, rows[0][3])]))
    read = []
    from signalspark.streaming import fold as module

    monkeypatch.setattr(module, "fold", lambda o, s=None, f=fold: read.append((o.count(), s.count() if s is not None else 0)) or f(o, s))
    log.advance()
    assert read == [(2, 1)]
    assert {(r["slug"]) for r in log.states.read(after=log.states.version() - 1).collect()} == {"p0", "new"}


def test_a_run_that_broke_off_between_its_commits_is_made_whole(spark, tmp_path, monkeypatch):
    log = DetectorLog(spark, str(tmp_path / "observations"), str(tmp_path / "detector"))
    rows = history(3, pages=3)
    log.observations.append(frame(spark, [r for r in rows if r[2] < 5]))
    with monkeypatch.context() as m:
        m.setattr(log.states, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.advance()
    log.observations.append(frame(spark, [r for r in rows if r[2] >= 5]))
    assert log.advance() == 0 and log.advance() > 0  # first up to where outcomes are, then the rest
    assert outcomes(log.outcomes.read()) == outcomes(D.detect(frame(spark, rows)))


# keyed stream ------------------------------------------------------------------------------------


class Value:
    def __init__(self):
        self.value, self.writes = None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1


class Map(dict):
    writes = 0

    def iterator(self):
        return iter(self.items())

    def updateValue(self, key, value):
        self[key] = value
        self.writes += 1


@pytest.mark.parametrize("seed", range(12))
def test_pages_with_a_state_a_signal_are_the_batch_pages(seed):
    rows = [r for r in history(seed, pages=1, reads=60)]
    own, signals, page, got, want = Value(), Map(), None, [], []
    rng = random.Random(seed)
    mine = keyed.Page(own, signals)
    for slug, kind, seq, observation in rows:
        if rng.random() < 0.4:  # a micro-batch ends here
            mine.save()
            mine = keyed.Page(own, signals)
        got += mine.read((slug, kind), seq, observation)
        more, page = D.outcome_rows((slug, kind), [{"seq": seq, "observation": observation}], page)
        want += more
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    mine.save()
    assert keyed.Page(own, signals).load() == page


def test_an_unchanged_page_writes_one_value():
    observed = {"at": "t1", "extractable": True, "variant": "html", "extractor_version": "1", "signals": {"headline": signal("a"), "subhead": signal("b"), "meta_title": None}}
    own, signals = Value(), Map()
    for i in range(4):
        mine = keyed.Page(own, signals)
        before = (own.writes, signals.writes)
        out = mine.read(("s", "home"), i, json.dumps(observed | {"at": f"t{i}"}))
        mine.save()
        assert len(out) == 3
        if i:
            assert (own.writes - before[0], signals.writes - before[1]) == (1, 0) and {r[6] for r in out} == {"unchanged", "no-data"}
    state = keyed.Page(own, signals).load()["state"]
    assert state["headline"]["good_at"] == "t3" and state["meta_title"]["nulls"] == 4
    mine = keyed.Page(own, signals)
    before = signals.writes
    mine.read(("s", "home"), 9, json.dumps(observed | {"at": "t9", "signals": observed["signals"] | {"subhead": signal("c")}}))
    assert signals.writes - before == 3  # times of all, and one new value


@pytest.mark.parametrize("initial", [False, True])
def test_the_keyed_stream_is_batch_over_restarts(spark, tmp_path, initial):
    """Also where a batch fold has read the first half, and its states begin the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.PROVIDER)
    rows, log = history(5), str(tmp_path / "log")
    want = outcomes(D.detect(frame(spark, rows)))
    states = None
    if initial:
        early = [r for r in rows if r[2] < 6]
        done = fold(frame(spark, early)).cache()
        CommitLog(spark, log).append(done.where("page is null").drop("page"), writer="batch", batch=0)
        states = done.where("page is not null").select("slug", "kind", "page")
    later = [(6, 8), (8, 12)] if initial else [(0, 4), (4, 8), (8, 12)]
    (tmp_path / "in").mkdir()
    try:
        for a, b in later:
            frame(spark, [r for r in rows if a <= r[2] < b]).coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(str(tmp_path / "in"))
            source = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
            sink = lambda batch, n: CommitLog(spark, log).append(batch, writer="stream", batch=n)
            stream = keyed.detect_keyed(source, states).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state"))
            stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert outcomes(CommitLog(spark, log).read()) == want


# growing files -----------------------------------------------------------------------------------


def lines_of(parts):
    return [(f, at, line) for p in parts for batch in tail.read_stretch(p) for f, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


@pytest.mark.parametrize("most", [1, 7, 64, 10**6])
def test_stretches_share_out_all_lines(tmp_path, most, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 16)
    rng = random.Random(most)
    lines = ["x" * rng.choice([0, 1, 5, 30, 200]) + str(i) for i in range(60)]
    text = "".join(line + "\n" for line in lines)
    path = tmp_path / "a.jsonl"
    path.write_text(text + "cut sho")
    end = tail.whole(str(tmp_path), str(path), 0, path.stat().st_size)
    assert end == len(text)
    got = lines_of(tail.stretches(str(tmp_path), {}, {str(path): end}, most))
    assert [line for _, _, line in got] == lines and all(text[at:].startswith(line + "\n") for _, at, line in got)
    start = len("".join(line + "\n" for line in lines[:40]))
    assert [line for _, _, line in lines_of(tail.stretches(str(tmp_path), {str(path): start}, {str(path): end}, most))] == lines[40:]


def test_only_what_was_appended_is_read(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"n": 1}\n{"n": 2}\n{"n"')
    reader = tail._Stream({"path": str(tmp_path)})
    begun = reader.initialOffset()
    first = reader.latestOffset()
    parts = reader.partitions(begun, first)
    assert [(p.start, p.end) for p in parts] == [(0, 18)] and len(lines_of(parts)) == 2
    with path.open("a") as out:
        out.write(': 3}\n')
    (tmp_path / "b.jsonl").write_text("x\n")
    second = reader.latestOffset()
    parts = reader.partitions(first, second)
    assert [(p.start, p.end) for p in parts] == [(18, 27), (0, 2)] and [line for _, _, line in lines_of(parts)] == ['{"n": 3}', "x"]
    again = tail._Stream({"path": str(tmp_path)})  # a restart has only the offsets
    assert again.partitions(second, again.latestOffset()) == []
    path.write_text("")
    with pytest.raises(ValueError, match="only grows"):
        reader.latestOffset()


def test_lines_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    path = folder / "a.jsonl"

    def run():
        stream = tail.tail_lines(spark, str(folder), "n long, v string").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, spark.read.schema("n long, v string").parquet(out).collect()))

    path.write_text('{"n": 1, "v": "é"}\nbroken\n[]\n{"n": "x"}\n{"n": 2, "v"')
    assert run() == [(1, "é")]
    with path.open("a") as more:
        more.write(': null, "other": 1}\n')
    assert run() == [(1, "é"), (2, None)] and run() == [(1, "é"), (2, None)]
    assert sorted(map(tuple, tail.tail_lines(spark, str(folder), "n long, v string", stream=False, stretch=8).collect())) == [(1, "é"), (2, None)]
