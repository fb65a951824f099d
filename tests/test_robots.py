"""robots.txt as tables, against the plain parser and a plain segment walk."""

import random
import re

import pytest

from signalspark.operators import robots as R
from signalspark.sources import robots as plain

NAMES = ["User-agent", "user-agent", "Allow", "Disallow", "DISALLOW", "Crawl-delay", "Content-Signal", "Sitemap", "Noise"]
AGENTS = ["*", "bot", "signal", "SignalBot", "signalbot-news", "other", ""]
PATTERNS = ["/", "/a", "/a*", "/*b", "/a/*/c$", "/ab$", "*", "", "/*", "/a**b$", "/%2Fx", "/(a)[.]", "$", "/a*$"]


def generated(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randrange(0, 16)):
        name = rng.choice(NAMES)
        value = {"u": lambda: rng.choice(AGENTS), "c": lambda: rng.choice(["1", "1,5", "0.25", "4000", "-1", "x", "search=no, ai-train=yes", "search=yes", "search=maybe,=no"])}.get(name[0].lower(), lambda: rng.choice(PATTERNS))()
        out.append(rng.choice(["", " ", "\t"]) + name + rng.choice([":", " : "]) + value + rng.choice(["", "", "  # why: not", " "]))
    return rng.choice(["\n", "\r\n"]).join([*out, rng.choice(["", "no colon", "#"])])


@pytest.fixture(scope="module")
def files():
    return {f"h{i}": generated(i) for i in range(150)}


@pytest.fixture(scope="module")
def lines(spark, files):
    return R.lines(spark.createDataFrame([*files.items(), ("null", None), (None, "User-agent: *\nDisallow: /")], "host string, body string")).cache()


def groups_of(lines, agent):
    rules, policies = {}, {}
    for r in R.rules_for(lines, agent).collect():
        rules.setdefault(r["host"], set()).add((r["allow"], r["pattern"]))
    for r in R.policies(lines, agent).collect():
        policies[r["host"]] = (r["matched"], r["crawl_delay"], r["signals"] or {})
    return rules, policies


def test_files_are_parsed_as_they_are_one_by_one(lines, files):
    for agent in ("SignalBot", "bot", "nobody"):
        rules, policies = groups_of(lines, agent)
        for host, body in files.items():
            groups = plain.parsed(body)
            group = plain.group_for(groups, agent)
            if group is None:
                assert host not in rules and host not in policies
                continue
            assert rules.get(host, set()) == set(group.rules), body
            matched, delay, signals = policies[host]
            assert groups[matched] is group and delay == group.crawl_delay and signals == {k: v for k, v in group.signals.items() if k}, body


def walks(pattern, path):
    """A pattern fits from the start; ``*`` is any text, a final ``$`` the end."""
    end = pattern.endswith("$")
    parts = [re.escape(p) for p in (pattern[:-1] if end else pattern).split("*")]
    return re.match("(?s)" + ".*".join(parts) + (r"\Z" if end else ""), path) is not None


def decide(rules, path):
    fitting = [(len(p), allow) for allow, p in rules if walks(p, path)]
    return max(fitting)[1] if fitting else True


def test_decisions_are_those_of_a_plain_walk(spark, lines, files):
    rng = random.Random(7)
    paths = ["/", "/a", "/ab", "/abc", "/a/b/c", "/a/b/cd", "/%2Fx", "/(a)[.]", "/xb", "/aXbYb", "/a\nb"]
    urls = [(h, p, i) for i, (h, p) in enumerate((rng.choice([*files, "unknown"]), rng.choice(paths)) for _ in range(900))] + [(None, "/", 1), ("h1", None, 2), (None, None, 3)]
    frame = spark.createDataFrame(urls, "host string, path string, n int")
    rules = R.rules_for(lines, "signalbot")
    held, _ = groups_of(lines, "signalbot")
    for bound in (0, 200_000):
        got = R.decisions(frame, rules, broadcast_rows=bound).collect()
        assert len(got) == len(urls)
        for r in got:
            if r["host"] is not None and r["path"] is not None:
                assert r["allowed"] == decide(held.get(r["host"], ()), r["path"]), r
            else:
                assert r["allowed"] and r["rule"] is None
    assert {r["allowed"] for r in got} == {True, False}


def test_ties_allow_and_a_declined_use_forbids(spark):
    body = "User-agent: *\nDisallow: /ab*\nAllow: /a*b\nContent-Signal: ai-train=no\n"
    lines = R.lines(spark.createDataFrame([("tie", body), ("no", body + "Content-Signal: search=no")], "host string, body string"))
    urls = spark.createDataFrame([("tie", "/ab"), ("no", "/x"), ("tie", "/ax")], "host string, path string")
    got = {(r["host"], r["path"]): (r["allowed"], r["rule"]) for r in R.decisions(urls, R.rules_for(lines, "x"), R.policies(lines, "x")).collect()}
    assert got == {("tie", "/ab"): (True, "/a*b"), ("no", "/x"): (False, "Content-Signal: search=no"), ("tie", "/ax"): (True, None)}


def test_decisions_have_no_cross_join_and_one_row_a_prefix(spark):
    """A third of the addresses on one host, thousands of hosts: each path meets only what it begins with."""
    from pyspark.sql import functions as F

    rules = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit(False).alias("allow"), F.concat(F.lit("/p"), (F.col("id") % 7).cast("string"), F.lit("*x")).alias("pattern"))
    urls = spark.range(9000).select(F.concat(F.lit("h"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 3000).cast("string")).alias("host"), F.concat(F.lit("/p"), (F.col("id") % 7).cast("string"), F.lit("/"), (F.col("id") % 50).cast("string"), F.lit("x")).alias("path"))
    done = R.decisions(urls, rules, broadcast_rows=0)
    plan = done._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    want = {True: 0, False: 0}
    for i in range(9000):
        want[(1 if i % 3 == 0 else i % 3000) % 7 != i % 7] += 1
    assert {r["allowed"]: r["count"] for r in done.groupBy("allowed").count().collect()} == want


def test_a_hosts_lines_are_dealt_out_once_without_their_files_text(spark):
    """Neither rules nor policies join the lines with themselves, and a line's row has no copy of its file."""
    frame = spark.range(50).selectExpr("concat('h', id) AS host", "concat('User-agent: *\\nDisallow: /', id, '\\nCrawl-delay: 2') AS body")
    lines = R.lines(frame)
    for done in (R.rules_for(lines, "x"), R.policies(lines, "x")):
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
        assert done.count() == 50
        assert all("body" not in row for row in re.findall(r"Sort \[([^\]]*)\]", plan) if "place" in row)


def test_files_of_one_host_follow_each_other_by_their_text(spark):
    two = [("h", "User-agent: b\nDisallow: /2"), ("h", "User-agent: a\nDisallow: /1"), ("h", None), ("h", "User-agent: a\nDisallow: /1")]
    got = [tuple(r) for r in R.lines(spark.createDataFrame(two, "host string, body string")).orderBy("line").select("value", "group").collect()]
    assert got == [("a", 1), ("a", 1), ("/1", 1), ("/1", 1), ("b", 2), ("/2", 2)]


@pytest.mark.parametrize("url, path", [("http://h/a%2fb%7E?q#f", "/a%2Fb~?q"), ("http://h", "/"), ("https://h?x", "/?x"), (None, "/"), ("http://h#f", "/")])
def test_normal_paths(spark, url, path):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(R.normal_path(frame.u)).first()[0] == path
