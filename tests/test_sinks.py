import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from signalspark import sinks
from signalspark.functions import fetching
from signalspark.operators import insights, readmodels, series, structure
from signalspark.sources import fetch, robots, seeds
from signalspark.streaming.detect import read_log


def test_documents_are_the_same_byte_by_byte(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "ä", [1, 2]), (3, None, [])], "id int, name string, tags array<int>")
    paths = sinks.write_documents(spark, str(tmp_path / "api"), {"companies": (rows.repartition(3), ["id"]), "empty": (rows.limit(0), ["id"])})
    first = [open(p, "rb").read() for p in paths]
    again = sinks.write_documents(spark, str(tmp_path / "api"), {"companies": (rows.repartition(2), ["id"]), "empty": (rows.limit(0), ["id"])})
    assert [open(p, "rb").read() for p in again] == first and json.loads(first[0]) == [{"id": 1, "name": "ä", "tags": [1, 2]}, {"id": 2, "name": "b"}, {"id": 3, "tags": []}]
    assert first[1] == b"[]\n"
    with pytest.raises(ValueError):
        sinks.document(spark.range(sinks.MOST_ROWS + 1), ["id"])


def test_lines_and_slim_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, (2, 3)), ("b", None, (4, 5))], "slug string, n int, s struct<x:int,y:int>")
    sinks.write_lines(rows, str(tmp_path / "lines"), "slug")
    assert json.loads(next((tmp_path / "lines" / "slug=b").glob("part*")).read_text()) == {"n": None, "s": {"x": 4, "y": 5}}
    assert sinks.slim(rows, ["n", "s.x", "t.z"]).schema.simpleString() == "struct<slug:string,s:struct<y:int>>"


def test_runs_are_always_kept_once(spark, tmp_path):
    log = str(tmp_path / "runs")
    run = lambda name: spark.createDataFrame([(name, 0, [])], "run string, targets int, results array<string>")
    assert sinks.append_run(run("r1"), log) == 1 and sinks.append_run(run("r2"), log) == 1
    with pytest.raises(ValueError):
        sinks.append_run(run("r1"), log)
    assert read_log(spark, log).count() == 2


def test_observations_are_kept_if_their_content_changed(spark, tmp_path):
    log, schema = str(tmp_path / "obs"), "slug string, seq int, at string, status string, signals map<string,string>"
    add = lambda *rows: sinks.append_observations(spark.createDataFrame(rows, schema), log, ["slug"], "seq", ("at",))
    assert add(("a", 1, "t1", "ok", {"h": "x"}), ("a", 2, "t2", "ok", {"h": "x", "never": None}), ("b", 1, "t1", "ok", {})) == 2
    assert add(("a", 3, "t3", "ok", {"h": "x"}), ("b", 2, "t2", "error", {})) == 1
    assert add(("a", 4, "t4", "ok", {"h": "y"}), ("a", 5, "t5", "ok", {"h": "x"}), ("a", 6, "t6", "ok", {"h": "x"})) == 2
    assert sorted((r["slug"], r["seq"]) for r in read_log(spark, log).collect()) == [("a", 1), ("a", 4), ("a", 5), ("b", 1), ("b", 2)]


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/same" and self.headers.get("If-None-Match") == '"v1"':
            self.send_response(304)
            self.end_headers()
            return
        code = {"/gone": 404, "/limit": 429}.get(self.path, 200)
        body = b"" if self.path == "/empty" else "<html>é</html>".encode() + b"x" * 5000
        self.send_response(code)
        self.send_header("ETag", '"v1"')
        self.send_header("Retry-After", "120")
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_pages_are_fetched(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    urls = [f"{root}/{p}" for p in ("ok", "same", "gone", "limit", "empty")] + ["http://127.0.0.1:1/closed", "no url"]
    targets = spark.createDataFrame([("h", u, '"v1"' if u.endswith("same") else None, None) for u in urls], "host string, url string, etag string, last_modified string")
    got = {r["url"].rpartition("/")[2]: r for r in fetch.fetched(targets, delay=0.0, most=100, timeout=5).collect()}
    server.shutdown()
    assert {k: r["status"] for k, r in got.items()} == {"ok": "ok", "same": "unchanged", "gone": "error", "limit": "blocked", "empty": "error", "closed": "error", "no url": "error"}
    assert got["ok"]["truncated"] and got["ok"]["bytes"] == 100 and got["ok"]["body"].startswith("<html>é") and got["ok"]["etag"] == '"v1"' and got["limit"]["retry_after"] == "120" and got["closed"]["error"]


def test_robots_are_kept_a_day_and_denied_when_unknown(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    known = spark.createDataFrame([("a", "A", "rules", "2024-01-01 12:00:00"), ("b", "B", "rules", "2023-12-31 12:00:00")], "host string, body string, rule string, at string").select("host", "body", "rule", F.col("at").cast("timestamp").alias("loaded_at"))
    loaded = spark.createDataFrame([("a", "new", 200), ("b", "x" * 600_000, 200), ("c", None, None), ("d", "", 404)], "host string, body string, http int")
    got = {r["host"]: r for r in fetch.robots_cache(known, loaded, now).collect()}
    assert got["a"]["body"] == "A" and len(got["b"]["body"]) == 512_000 and (got["c"]["rule"], got["d"]["rule"]) == ("deny", "allow") and robots.parsed(got["c"]["body"]) == {}


def test_seed_and_label_files(spark, tmp_path):
    rows = [{"slug": "a", "name": "A", "segment": "s", "homepage_url": "https://a.com", "x": 1}, {"slug": "b", "name": "B", "segment": "s", "homepage_url": "https://b.com", "pricing_url": "https://b.com/p"}]
    for k, value in enumerate((rows, {"version": 1, "companies": rows})):
        path = tmp_path / f"seed{k}.json"
        path.write_text(json.dumps(value, indent=1))
        found = seeds.read_seed(spark, str(path))
        assert [r["slug"] for r in found.collect()] == ["a", "b"] and seeds.targets(found).count() == 3
    (tmp_path / "labels.json").write_text(json.dumps({"labels": [{"slug": "a", "sections": [{"heading": None, "type": "hero"}, {"heading": "H", "type": "faq"}]}]}))
    assert sorted(map(tuple, seeds.read_labels(spark, str(tmp_path / "labels.json")).collect())) == [("a", "H", "faq"), ("a", "__hero__", "hero")]


def test_targets_of_a_run(spark):
    targets = spark.createDataFrame([("a", "home"), ("a", "pricing"), ("b", "home")], "slug string, kind string")
    queue = spark.createDataFrame([("a", "home", "2024-01-01"), ("b", "home", "2024-03-01")], "slug string, kind string, next_due_at string")
    run = lambda **k: [(r["slug"], r["kind"]) for r in series.select_targets(targets, queue, ["slug", "kind"], **k).collect()]
    assert run(mode="batch", now=F.lit("2024-02-01"), limit=9) == [("a", "pricing"), ("a", "home")] and run(mode="batch", now=F.lit("2024-02-01"), limit=0) == []
    assert sorted(run(mode="company", company="a")) == [("a", "home"), ("a", "pricing")] and len(run(mode="all")) == 3
    for wrong in ({"mode": "company", "company": "z"}, {"mode": "batch", "limit": -1}, {"mode": "other"}):
        with pytest.raises(ValueError):
            run(**wrong)
    fetched = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "slug string, content_hash string")
    known = spark.createDataFrame([("a", "x"), ("b", "other")], "slug string, content_hash string")
    assert sorted(r["slug"] for r in series.skipped_unchanged(fetched, known, ["slug"]).collect()) == ["b", "c"]


def test_hashes_of_content(spark):
    page = lambda nonce, at: f'<html nonce="{nonce}"><script>var t="{at}"</script><p>Words  here</p> <!-- {at} --></html>'
    rows = spark.createDataFrame([(page("a1", "2024-01-01T10:00:00Z"),), (page("b2", "2024-01-02T11:30:00.5Z"),), (page("b2", "x"),)], "b string")
    h = [r[0] for r in rows.select(fetching.content_hash(F.col("b"))).collect()]
    assert h[0] == h[1] != h[2]
    one = rows.limit(1).select(fetching.hash_json(F.struct(F.lit("a").alias("x"), F.lit(None).cast("int").alias("y")))).first()[0]
    assert len(one) == 8


def test_names_are_sorted_as_people_do(spark):
    rows = spark.createDataFrame([(w, 1) for w in ("b", "B", "a", "A", "ab", "é", "f", "e")], "k string, n int")
    assert [r["k"] for r in insights.most_first(rows, "n", "k").collect()] == ["a", "A", "ab", "b", "B", "e", "é", "f"]


def test_three_valued_answers(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "an agentic tool", None), (3, "quiet", None), (4, None, "Copilots")], "id int, a string, b string")
    assert tuple(insights.ai_answers(rows, ["a", "b"]).first()) == (2, 1, 1)
    assert {r["field"]: (r["mention"], r["readable"]) for r in insights.ai_by_field(rows, ["a", "b"]).collect()} == {"a": (1, 2), "b": (1, 1)}
    assert {r["family"]: r["n"] for r in insights.ai_by_term(rows, ["a", "b"]).collect()}["copilot"] == 1


def test_accessors(spark):
    schema = "signals map<string,struct<value:string,json:string>>"
    sections = '{"sections": [{"position": 1, "type": "hero", "heading": null, "words": 3, "merged": 1}]}'
    rows = spark.createDataFrame([({"a": ("USD 1,234.50 per seat", "{"), "b": ("", None), "anatomy_sections": ("hero", sections)},), ({"a": None},), (None,)], schema)
    s = F.col("signals")
    got = rows.select(readmodels.number_of(readmodels.signal_value(s, "a")).alias("n"), readmodels.signal_value(s, "b").alias("b"), F.size(readmodels.sections_of(s)).alias("k"), readmodels.signal_json(s, "a", "x int").alias("j")).collect()
    assert got[0]["n"] == 1234.5 and got[0]["b"] is None and got[0]["k"] == 1 and got[1]["n"] is None and got[2]["n"] is None
    assert rows.limit(1).select(readmodels.max_of(F.lit("2024-01-01"), F.lit(None).cast("string"), F.lit("2024-02-01")).alias("m")).first()["m"] == "2024-02-01"


def test_near_unanimous_shares(spark):
    rows = spark.createDataFrame([(95.0,), (50.0,), (3.0,), (None,)], "share double")
    assert [r["near_unanimous"] for r in structure.withheld_note(rows).collect()] == [True, False, True, None]


def test_markup_is_stripped_in_time(spark):
    import time

    from signalspark.functions import markup, text as T

    page = "<p>a</p><!-- x --><script>y</script ><SVG><path/></SVG>b<style>z</style>c"
    pages = ["<!--" * 200_000, "<script>" * 100_000, page, "<svg>open " + page, None, ""]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    began = time.time()
    got = {r["i"]: (r["code"], r["svg"]) for r in rows.select("i", T.strip_code(F.col("h")).alias("code"), T.strip_svg(F.col("h")).alias("svg")).collect()}
    assert time.time() - began < 20
    assert got[0] == (pages[0], pages[0]) and got[1] == (pages[1], pages[1]) and got[4] == (None, None) and got[5] == ("", "")
    assert got[2] == ("<p>a</p>  <SVG><path/></SVG>b c", "<p>a</p><!-- x --><script>y</script > b<style>z</style>c")
    assert markup.without_drawings("a<svg><path/></svg>b<svg>c") == "a b c" and markup.without_drawings("x") == "x"
    assert markup.without_code(page) == "<p>a</p>  <SVG><path/></SVG>b c"
