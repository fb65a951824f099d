"""Queries of whole views: every frame of a bundle as rows, and a company's page as one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import bundles, insights, readmodels, series
from ..registry import query, table
from .insights import _FIELDS, _FIELDS_SQL, _HITS_SQL, _PLANS_SQL, _STOP_SQL, _TERMS_SQL, _WORDS, fields_of, plans_of
from .readmodels import _CUSTOMERS_SQL, _QUEUE_SQL, _companies, _signals
from .series import _observations


def _positioning(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = fields_of(spark, sf_dir).join(plans_of(spark, sf_dir).drop("name"), "slug").join(_companies(spark, sf_dir).select("slug", "segment"), "slug").withColumn("logos", F.array("segment"))
    cuts = {"mentions": insights.mentions(_FIELDS), "free": F.col("free")}
    return bundles.state_of_positioning(rows, "headline", _FIELDS, "tiers", "free", "subhead", "logos", "segment", cuts)


def _as_rows(frames: dict[str, DataFrame], parts: dict[str, tuple[str, str]]) -> DataFrame:
    """``(part, key, n)`` of a key and a number of each frame."""
    text = lambda name, key, n: frames[name].select(F.lit(name).alias("part"), F.expr(key).cast("string").alias("key"), F.expr(n).cast("double").alias("n"))
    return reduce(DataFrame.union, (text(name, *how) for name, how in parts.items()))


_SAID = f"{_FIELDS_SQL}, {_TERMS_SQL}, {_PLANS_SQL}, {_CUSTOMERS_SQL}, said AS (SELECT *, {_HITS_SQL} FROM fields), answers AS (SELECT *, CASE WHEN coalesce(headline, subhead, label) IS NOT NULL THEN headline_hit OR subhead_hit OR label_hit END AS ai FROM said)"
_DIM = "dim(bucket, low, high) AS (VALUES " + ", ".join(f"('{k}', {a}, {'1e300' if b is None else b})" for k, a, b in M.PRICE_BUCKETS) + ")"


@query(
    f"""WITH {_SAID}, {_DIM}, votes AS (SELECT DISTINCT slug, unnest(list_filter({_WORDS.format(t='headline')}, lambda w: length(w) >= 3)) AS word FROM fields), w AS (SELECT word, count(*) AS n FROM votes WHERE word NOT IN ({_STOP_SQL}) GROUP BY word ORDER BY n DESC, word LIMIT 12),
each AS ({' UNION ALL '.join(f"SELECT slug, unnest({_WORDS.format(t=c)}) AS w FROM fields" for c in _FIELDS)}), cell AS (SELECT segment, ai, free FROM companies c JOIN answers a ON c.slug = a.slug JOIN company p ON c.slug = p.slug)
SELECT 'headline_words' AS part, word AS key, n::DOUBLE AS n FROM w
UNION ALL SELECT 'category_nouns', NULL, count(*) FROM fields WHERE headline IS NOT NULL
UNION ALL SELECT 'ai_answers', 'all', count(*) FILTER (WHERE ai) * 1000000 + count(*) FILTER (WHERE NOT ai) * 1000 + count(*) FILTER (WHERE ai IS NULL) FROM answers
UNION ALL {' UNION ALL '.join(f"SELECT 'ai_by_field', '{c}', count(*) FILTER (WHERE {c}_hit) * 100000 + count({c}) FROM said" for c in _FIELDS)}
UNION ALL SELECT 'ai_by_term', f.family, count(DISTINCT slug) FROM (SELECT DISTINCT family FROM terms) f LEFT JOIN terms t ON t.family = f.family LEFT JOIN each ON form = w GROUP BY f.family
UNION ALL SELECT 'pricing', 'median', quantile_disc(entry, 0.5) FROM company
UNION ALL SELECT 'entry_buckets', bucket, count(slug) FROM dim LEFT JOIN company ON entry >= low AND entry < high GROUP BY bucket
UNION ALL SELECT 'currency_mix', currency, count(DISTINCT slug) FROM plans WHERE currency IS NOT NULL GROUP BY currency
UNION ALL SELECT 'logo_mentions', lower(segment) || '=' || segment, count(*) FROM companies GROUP BY segment
UNION ALL SELECT 'segments', segment || '/mentions', count(*) FILTER (WHERE ai) * 1000000 + count(*) FILTER (WHERE NOT ai) * 1000 + count(*) FILTER (WHERE ai IS NULL) FROM cell GROUP BY segment
UNION ALL SELECT 'segments', segment || '/free', count(*) FILTER (WHERE free) * 1000000 + count(*) FILTER (WHERE NOT free) * 1000 + count(*) FILTER (WHERE free IS NULL) FROM cell GROUP BY segment"""
)
def positioning_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the positioning view, from one scan of the companies."""
    frames = _positioning(spark, sf_dir)
    three = "yes * 1000000L + no * 1000 + unreadable"
    return _as_rows(
        frames,
        {
            "headline_words": ("word", "n"), "category_nouns": ("noun", "n"), "ai_answers": ("'all'", "mention * 1000000L + quiet * 1000 + unreadable"), "ai_by_field": ("field", "mention * 100000L + readable"), "ai_by_term": ("family", "n"),
            "pricing": ("'median'", "median_entry"), "entry_buckets": ("bucket", "n"), "currency_mix": ("currency", "n"), "logo_mentions": ("key || '=' || spelling", "n"), "segments": ("group || '/' || cut", three),
        },
    )


@query(
    """WITH s AS (SELECT conv_id, string_agg(role, ' > ' ORDER BY turn) AS q, count(*) AS n, count(*) FILTER (WHERE role = 'tool') AS other, sum(length(text))::DOUBLE AS words FROM conversations GROUP BY conv_id),
v AS (SELECT list_sort(list(words)) AS v, count(*) AS n FROM s)
SELECT 'quality' AS part, 'share' AS key, floor(sum(other) / sum(n) * 1000 + 0.5) / 1000 AS n FROM s
UNION ALL SELECT 'worst_pages', conv_id::VARCHAR, share FROM (SELECT conv_id, floor(other / n * 1000 + 0.5) / 1000 AS share, n FROM s WHERE other > 0 ORDER BY share DESC, n DESC, conv_id LIMIT 20)
UNION ALL SELECT 'positions', turn || role, floor(count(*) * 1000 / sum(count(*)) OVER (PARTITION BY turn) + 0.5) / 10 FROM conversations WHERE turn < 8 GROUP BY turn, role
UNION ALL SELECT 'elements', r, count(DISTINCT conv_id) FROM (VALUES ('system'), ('user'), ('assistant'), ('tool')) t(r) LEFT JOIN conversations ON role = r GROUP BY r
UNION ALL SELECT 'scales', 'words', v[least(n, floor(0.75 * n) + 1)::BIGINT] FROM v
UNION ALL SELECT 'strips', conv_id || q, words FROM s
UNION ALL SELECT 'vocabulary', r, k FROM (VALUES ('system', 0), ('user', 1), ('assistant', 2), ('tool', 3)) t(r, k)"""
)
def anatomy_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the anatomy view, turns being sections and roles their types."""
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("double").alias("size"))
    frames = bundles.page_anatomy(items, "conv_id", "turn", "role", "size", ["system", "user", "assistant", "tool"], "tool")
    frames["scales"] = frames["scales"].where("measure = 'words'")
    return _as_rows(
        frames,
        {"quality": ("'share'", "share"), "worst_pages": ("conv_id", "share"), "positions": ("concat(turn, role)", "share"), "elements": ("role", "n"), "scales": ("measure", "p75"), "strips": ("concat(conv_id, sequence)", "words"), "vocabulary": ("role", "place")},
    )


@query(
    f"""WITH {_CUSTOMERS_SQL}, {_QUEUE_SQL}, last AS (SELECT user_id AS slug, event_type, max(event_id) AS id FROM events GROUP BY ALL), v AS (SELECT l.slug, l.event_type AS signal, CASE WHEN id % 4 > 0 THEN value::DECIMAL(12,2)::VARCHAR END AS value FROM last l JOIN events e ON e.event_id = id),
sig AS (SELECT slug, string_agg(signal || '=' || coalesce(value, '?'), ' ' ORDER BY signal) AS signals FROM v GROUP BY slug),
ok AS (SELECT user_id, arg_max(ts, event_id) AS last_ok_at FROM obs WHERE status IN ('ok', 'unchanged') GROUP BY user_id),
ev AS (SELECT r.user_id AS slug, string_agg(event_id || CASE WHEN coalesce(last_ok_at > ts, false) THEN '+' ELSE '-' END, ' ' ORDER BY place) AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE event_id % 11 <> 0) r LEFT JOIN ok ON ok.user_id = r.user_id WHERE place <= 6 GROUP BY r.user_id),
fe AS (SELECT user_id AS slug, string_agg(event_id || ':' || status, ' ' ORDER BY event_id DESC) AS fetches FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM obs) WHERE place <= 4 GROUP BY user_id),
qu AS (SELECT slug, string_agg(kind || ':' || status, ' ' ORDER BY kind <> 'home', kind) AS queue FROM (SELECT slug, CASE WHEN event_type = 'view' THEN 'home' ELSE event_type END AS kind, status FROM q) GROUP BY slug)
SELECT c.slug, c.name, c.segment, coalesce(queue, '') AS queue, coalesce(signals, '') AS signals, coalesce(events, '') AS events, coalesce(fetches, '') AS fetches
FROM companies c LEFT JOIN qu ON qu.slug = c.slug LEFT JOIN sig ON sig.slug = c.slug LEFT JOIN ev ON ev.slug = c.slug LEFT JOIN fe ON fe.slug = c.slug"""
)
def company_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's page as one row: its queue, its signals, its published events with confirmation, its last fetches."""
    rows = _observations(spark, sf_dir)
    kinds = F.when(F.col("event_type") == "view", "home").otherwise(F.col("event_type"))
    queue = series.queue(rows, ["user_id", "event_type"], "event_id", "ts", "status", "version").select(F.col("user_id").alias("slug"), kinds.alias("kind"), F.col("last_status").alias("status"))
    whole = series.queue(rows, ["user_id"], "event_id", "ts", "status", "version").withColumnRenamed("user_id", "slug")
    events = table(spark, sf_dir, "events").where("event_id % 11 <> 0").select(F.col("user_id").alias("slug"), "event_id", "ts")
    events = readmodels.company_events(events, whole, "slug", ["event_id"], "ts", 6)
    fetches = readmodels.company_fetches(rows.select(F.col("user_id").alias("slug"), "event_id", "status"), "slug", "event_id", 4)
    signals = readmodels.latest_signals(_signals(spark, sf_dir), "slug", "event_id")
    found = bundles.company_documents(_companies(spark, sf_dir), queue, signals, events, fetches, "slug")
    told = lambda name, item: F.array_join(F.transform(name, item), " ").alias(name)
    return found.select(
        "slug", "name", "segment", told("queue", lambda x: F.concat(x["kind"], F.lit(":"), x["status"])), told("signals", lambda x: F.concat(x["signal"], F.lit("="), F.coalesce(x["state"]["value"], F.lit("?")))),
        told("events", lambda x: F.concat(x["event_id"].cast("string"), F.when(x["confirmed"], "+").otherwise("-"))), told("fetches", lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["status"])),
    )
