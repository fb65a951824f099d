"""Queries over numbers as text, and over what fetches give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fetching, formats
from ..operators import series
from ..registry import ORACLES, query, table
from .insights import _FIELDS_SQL, _HITS_SQL, _PLANS_SQL, _TERMS_SQL, ai_answers, pricing_shape
from .readmodels import _CUSTOMERS_SQL, _QUEUE_SQL, _health, carriers_and_absent
from .series import _OBS_SQL, _observations


@query(
    """SELECT p_partkey, format('{:,}', p_partkey * 1237) AS num, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
  upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS title,
  least(90, greatest(26, floor(p_size * 90 / 50 + 0.5)))::BIGINT AS height, CASE WHEN p_size % 7 > 0 THEN floor(p_size * 100 / (p_size + p_size % 7) + 0.5)::BIGINT || '% (' || p_size || ' of ' || (p_size + p_size % 7) || ')' ELSE 'no readable page' END AS share,
  floor(p_size * 100 / 50 * 100 + 0.5) / 100 AS width, replace(replace(p_brand || '<' || p_type, '<', '&lt;'), '#', '#') AS escaped, CASE WHEN length(p_name || p_type) <= 12 THEN p_name || p_type ELSE left(p_name || p_type, 9) || '…' END AS clipped FROM part"""
)
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, rest = F.col("p_size"), F.col("p_size") % 7
    return table(spark, sf_dir, "part").select(
        "p_partkey", formats.num(F.col("p_partkey") * 1237).alias("num"), formats.ordinal(F.col("p_partkey")).alias("ordinal"), formats.title_case(F.col("p_name")).alias("title"), formats.block_height(size, F.lit(50)).alias("height"),
        formats.share_text(size, F.when(rest > 0, size + rest).otherwise(0)).alias("share"), formats.width(size, F.lit(50)).alias("width"), formats.escape_html(F.concat("p_brand", F.lit("<"), "p_type")).alias("escaped"),
        formats.clipped(F.concat("p_name", "p_type"), 12).alias("clipped"),
    )


@query(
    f"""WITH counted AS ({ORACLES["carriers_and_absent"]}), s AS (SELECT role, carriers / (carriers + absent) AS share FROM counted WHERE carriers + absent > 0)
SELECT role, share, CASE WHEN share >= 0.9 THEN 'nearly every page' WHEN share >= 0.66 THEN 'most pages' WHEN share >= 0.45 THEN 'about half of pages' WHEN share >= 0.3 THEN 'about a third of pages' ELSE 'a minority of pages' END AS words FROM s"""
)
def prevalence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of conversations has a turn of each role, in words."""
    counted = carriers_and_absent(spark, sf_dir).where("carriers + absent > 0")
    shares = counted.select("role", (F.col("carriers") / (F.col("carriers") + F.col("absent"))).alias("share"))
    return shares.select("role", "share", formats.prevalence_words(F.col("share")).alias("words"))


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN least(page_id * 997, 86400) WHEN 1 THEN least(greatest(3600 - page_id % 2 * 7200 + page_id * 60, 0), 86400) WHEN 2 THEN 0 ELSE -1 END AS seconds FROM pages"""
)
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers are made up from page_id: seconds, dates, a negative number, words and none."""
    p = F.col("page_id")
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    date = F.concat(F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + 3600 - p % 2 * 7200 + p * 60), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    header = F.when(p % 5 == 0, (p * 997).cast("string")).when(p % 5 == 1, date).when(p % 5 == 2, F.lit("-5")).when(p % 5 == 3, F.lit("soon"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(fetching.retry_after(header, now), F.lit(-1)).alias("seconds"))


@query(f"WITH {_OBS_SQL} SELECT event_id FROM obs WHERE version IS DISTINCT FROM '1.3'")
def stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).where(fetching.stale_extractor(F.col("version"), "1.3")).select("event_id")


@query(
    r"""SELECT page_id, length(substr(trim(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 400000)) AS n_chars,
  length(substr(html, 1, 1500)) AS n_capped FROM pages"""
)
def normalised_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(fetching.normalised(html)).cast("long").alias("n_chars"), F.length(fetching.capped(html, 1500)).cast("long").alias("n_capped"))


@query(
    """WITH b AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://[^/?#]+') AS root, regexp_extract(url, '^https?://[^/?#]+(/.*/|/)[^?#/]*', 1) AS folder FROM pages),
dots AS (SELECT page_id, list_reduce(list_transform(string_split(folder[2:] || '../up/./f', '/'), lambda s: [s]), lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN a[:len(a) - 1] ELSE list_concat(a, s) END, []::VARCHAR[]) AS parts FROM b)
SELECT b.page_id, CASE b.page_id % 8 WHEN 0 THEN 'https://x.org/a' WHEN 1 THEN scheme || '://cdn.net/b' WHEN 2 THEN root || '/c?d' WHEN 3 THEN root || folder || 'e.html'
  WHEN 6 THEN root || '/' || array_to_string(parts, '/') || '?x=../y' WHEN 7 THEN 'https://cdn.net/#A' END AS full_url FROM b JOIN dots ON b.page_id = dots.page_id"""
)
def absolute_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id") % 8
    link = F.when(p == 0, "https://x.org/a").when(p == 1, "//cdn.net/b").when(p == 2, " /c?d").when(p == 3, "e.html").when(p == 4, "mailto:a@b.c").when(p == 6, "../up/./f?x=../y").when(p == 7, "HTTPS://Cdn.NET:443#A")
    return table(spark, sf_dir, "pages").select("page_id", fetching.absolute_url(link, F.col("url")).alias("full_url"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN upper(left(event_type, 2)) END AS country, CASE WHEN event_id % 2 > 0 THEN upper(left(event_type, 3)) END AS region,
  (CASE WHEN event_id % 5 > 0 THEN 'ci' ELSE 'unknown' END) || ':' || (CASE WHEN event_id % 3 > 0 THEN upper(left(event_type, 2)) ELSE 'unknown' END) AS id FROM events"""
)
def traced_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces are made up from event types."""
    k = F.col("event_id")
    country = F.when(k % 3 > 0, F.upper(F.substring("event_type", 1, 2))).otherwise("??")
    region = F.when(k % 2 > 0, F.upper(F.substring("event_type", 1, 3))).otherwise("x")
    body = F.concat(F.lit("fl=1\nh=a.b\nloc="), country, F.lit("\ncolo="), region, F.lit("\n"))
    origin = fetching.traced_origin(body, F.when(k % 5 > 0, "ci"))
    return table(spark, sf_dir, "events").select("event_id", origin.alias("o")).select("event_id", "o.country", "o.region", "o.id")


@query(
    f"""WITH {_OBS_SQL}, r AS (SELECT date_trunc('day', ts) AS run, count(*) AS targets, count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'blocked') AS blocked FROM obs GROUP BY 1),
m AS (SELECT date_trunc('day', ts) AS run, user_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY user_id) AS k FROM (SELECT DISTINCT date_trunc('day', ts) AS ts, user_id FROM events WHERE event_type = 'purchase')),
n AS (SELECT run, string_agg('u' || user_id, ', ' ORDER BY k) FILTER (WHERE k <= 3) || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS movers FROM m GROUP BY run)
SELECT strftime(r.run, '%Y-%m-%d') AS run, concat_ws('; ', r.targets || ' targets', movers, CASE WHEN error > 0 THEN error || ' error' END, CASE WHEN blocked > 0 THEN blocked || ' blocked' END) AS message FROM r LEFT JOIN n ON r.run = n.run"""
)
def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).withColumn("run", F.date_format("ts", "yyyy-MM-dd"))
    movers = rows.where("event_type = 'purchase'").select("run", "user_id").distinct()
    return series.run_messages(rows, movers, "run", "status", "user_id", ("error", "blocked"), "u")


@query(
    f"""WITH {_CUSTOMERS_SQL}, {_QUEUE_SQL}, bound AS (SELECT max(ts) - INTERVAL 48 HOUR AS cutoff FROM obs), h AS (
SELECT m.slug, CASE WHEN p.attempt IS NULL THEN 'pending' WHEN p.status = 'blocked' THEN 'blocked' WHEN p.ok_at IS NULL OR p.ok_at < cutoff THEN 'stale' WHEN p.status = 'error' THEN 'error' WHEN coalesce(suspect, 0) > 0 THEN 'degraded' ELSE 'ok' END AS state
FROM companies m LEFT JOIN p ON m.slug = p.slug LEFT JOIN s ON m.slug = s.slug, bound) SELECT state, count(*) AS n FROM h GROUP BY state"""
)
def health_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_PLANS_SQL}, {_FIELDS_SQL}, {_TERMS_SQL}, said AS (SELECT *, {_HITS_SQL} FROM fields), a AS (SELECT coalesce(headline, subhead, label) IS NOT NULL AS readable, headline_hit OR subhead_hit OR label_hit AS ai FROM said)
SELECT (SELECT format('{{:,}}', count(*)) FROM customer) AS companies, (SELECT floor(count(*) FILTER (WHERE readable AND ai) * 100 / count(*) FILTER (WHERE readable) + 0.5)::BIGINT || '% (' || format('{{:,}}', count(*) FILTER (WHERE readable AND ai)) || ' of ' || format('{{:,}}', count(*) FILTER (WHERE readable)) || ')' FROM a) AS ai,
  floor(count(*) FILTER (WHERE free) * 100 / count(free) + 0.5)::BIGINT || '% (' || format('{{:,}}', count(*) FILTER (WHERE free)) || ' of ' || format('{{:,}}', count(free)) || ')' AS free, quantile_disc(entry, 0.5) AS median_entry FROM company"""
)
def kpi_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four figures for a front page: companies, those that mention machine intelligence, those with
    a free plan, and the median entry price."""
    prices, ai = pricing_shape(spark, sf_dir), ai_answers(spark, sf_dir)
    companies = table(spark, sf_dir, "customer").agg(formats.num(F.count("*")).alias("companies"))
    one = companies.crossJoin(ai).crossJoin(prices)
    return one.select(
        "companies", formats.share_text(F.col("mention"), F.col("mention") + F.col("quiet")).alias("ai"), formats.share_text(F.col("free_yes"), F.col("free_yes") + F.col("free_no")).alias("free"), "median_entry"
    )
