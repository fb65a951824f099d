"""Whole views: each frame is what its own function gives, from one scan; companies' pages as rows."""

import pytest
from pyspark.sql import functions as F

from signalspark.functions import fetching
from signalspark.operators import bundles, insights, positioning, segments, sequences, structure

SCHEMA = "slug int, headline string, subhead string, label string, tiers array<struct<name:string,amount:double,currency:string>>, free boolean, said string, logos array<string>, segment string"
FIELDS = ["headline", "subhead", "label"]


@pytest.fixture(scope="module")
def companies(spark):
    rows = [
        (1, "The agentic platform for teams teams", "AI for all", None, [("pro", 20.0, "USD"), ("max", None, "USD")], True, "3x faster builds. 10,000+ customers. 40% lower costs", ["Acme", "ACME", "Beta"], "a"),
        (2, "A platform of tools", None, "crm", [("free", 0.0, None), ("one", 5.5, "EUR")], False, "10,000+ customers and 2x faster builds", ["acme", None], "a"),
        (3, None, None, None, None, None, None, None, "b"),
        (4, "Words without a noun here", "copilot", "x", [], None, "nothing", [], None),
        (5, "Cloud", "", "agents", [("a", 5.5, "EUR"), ("b", 7.0, "USD")], True, "in 5 minutes. save $5 million a year", ["Acme"], "b"),
        (6, None, "quiet", None, [("s", None, None)], False, "", ["Beta"], "a"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def cuts():
    return {"mentions": insights.mentions(FIELDS), "free": F.col("free")}


@pytest.fixture(scope="module")
def view(companies, cuts):
    return bundles.state_of_positioning(companies, "headline", FIELDS, "tiers", "free", "said", "logos", "segment", cuts)


def same(a, b):
    columns = sorted(b.columns)
    rows = lambda f: sorted(map(repr, (tuple(r) for r in f.select(*columns).collect())))
    assert sorted(a.columns) == columns and rows(a) == rows(b)


def test_positioning_frames_are_their_own_functions(companies, cuts, view):
    same(view["headline_words"], insights.headline_words(companies, "headline"))
    same(view["category_nouns"], positioning.category_groups(companies, "headline"))
    same(view["ai_answers"], insights.ai_answers(companies, FIELDS))
    same(view["ai_by_field"], insights.ai_by_field(companies, FIELDS))
    same(view["ai_by_term"], insights.ai_by_term(companies, FIELDS))
    same(view["pricing"], insights.pricing_shape(companies, "tiers", "free"))
    same(view["entry_buckets"], insights.entry_buckets(companies, "tiers"))
    same(view["currency_mix"], insights.currency_mix(companies, "tiers"))
    same(view["proof_claims"], insights.proof_claims(companies, "said"))
    same(view["logo_mentions"], positioning.modal_spelling(companies.select("slug", F.explode("logos").alias("name")).where("name is not null"), "slug", "name"))
    same(view["segments"], segments.cells(companies, "segment", cuts))
    assert view["proof_claims"].count() >= 4 and view["segments"].count() == 4


def test_positioning_is_one_scan(companies, view):
    """The frames' plans read the sums, which were made once."""
    for frame in view.values():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "headline" not in plan.replace("headline_words", "") and "ExistingRDD" in plan


def test_positioning_of_no_rows(companies, cuts):
    view = bundles.state_of_positioning(companies.limit(0), "headline", FIELDS, "tiers", "free", "said", "logos", "segment", cuts)
    assert view["headline_words"].count() == 0 and view["segments"].count() == 0 and view["entry_buckets"].agg(F.sum("n")).first()[0] == 0
    assert view["pricing"].first()["median_entry"] is None and view["ai_by_field"].count() == 3


def test_anatomy_frames_are_their_own_functions(spark):
    items = spark.createDataFrame([(p, k, s, float(w)) for p, row in enumerate(["hero other pricing", "hero faq", "other", "hero hero other other"]) for k, s in enumerate(row.split()) for w in [10 * p + k]], "page int, position int, type string, words double")
    view = bundles.page_anatomy(items, "page", "position", "type", "words", ["hero", "pricing", "faq", "gone"])
    whole, worst = structure.classifier_quality(items, "page", "type", "other")
    same(view["quality"], whole)
    same(view["worst_pages"], worst)
    same(view["positions"], sequences.position_profile(items, "position", "type"))
    same(view["elements"], sequences.prevalence(items, "page", "type", ["hero", "pricing", "faq", "gone"]))
    strips = structure.company_strips(items, "page", "position", "type", "words")
    same(view["strips"], strips)
    same(view["scales"], structure.page_scales(strips))


def test_a_company_without_a_history_has_empty_lists(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "slug int, name string")
    queue = spark.createDataFrame([(1, "pricing", "ok"), (1, "home", "error")], "slug int, kind string, status string")
    signals = spark.createDataFrame([(1, {"b": ("x",), "a": (None,)})], "slug int, signals map<string,struct<value:string>>")
    rows = lambda n: spark.createDataFrame([(1, k, f"e{k}") for k in range(n, 0, -1)], "slug int, place int, what string")
    got = {r["slug"]: r for r in bundles.company_documents(one, queue, signals, rows(9), rows(30), "slug", 5, 20).collect()}
    assert [q["kind"] for q in got[1]["queue"]] == ["home", "pricing"] and [s["signal"] for s in got[1]["signals"]] == ["a", "b"]
    assert [e["what"] for e in got[1]["events"]] == ["e1", "e2", "e3", "e4", "e5"] and len(got[1]["fetches"]) == 20
    assert all(got[2][c] == [] for c in ("queue", "signals", "events", "fetches"))


@pytest.mark.parametrize("token", ["nonce", "csrf_token", "csrf-token", "csrftoken", "build-id", "buildId", "build_id", "deployment-id", "request_id", "requestid", "trace-id", "TRACE_ID", "data-nonce"])
def test_volatile_tokens_make_no_difference(spark, token):
    frame = spark.createDataFrame([(f'<p {token} = "{v}">at {t} x<script {v}>{v}</script></p>', f"<p {token}={v}>") for v, t in (("a1", "2026-01-01T00:00:00Z"), ("b-2", "2026-02-01T10:00:00.123Z"))], "body string, bare string")
    same_, kept = frame.select(fetching.content_hash(F.col("body")).alias("h"), fetching.content_hash(F.col("bare")).alias("b")).agg(F.countDistinct("h"), F.countDistinct("b")).first()
    assert (same_, kept) == (1, 2)  # an unquoted value is content


@pytest.mark.parametrize("text", ["2026-01-01T00:00:00", "2026-01-01T00:00:00+01:00", "release-hash: abc", 'data-other="x"'])
def test_what_is_not_volatile_stays(spark, text):
    assert spark.range(1).select(fetching.normalised(F.lit(f"<p> {text} </p>"))).first()[0] == f"<p> {text} </p>"
