"""Queries over raw web pages: markup to values, and what to fetch when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import ENTITIES
from ..operators import positioning, series
from ..registry import query, table

_STRIP_SQL = """stripped AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'),
    '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'), '(?is)<template\\b[^>]*>.*?</template\\s*>', ' ', 'g') AS h FROM pages
)"""
_SPACE = r"[\s\x{a0}\x{2007}\x{202f}\x{2009}\x{200a}\x{200b}\x{200c}\x{200d}\x{feff}]+"


_NAMES_SQL = "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in ENTITIES.items()) + "}"


def _decoded_sql(value: str) -> str:
    """SQL of ``T.decode_entities`` for numbers of at most six digits."""
    body = "regexp_extract(p, '^(#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,10});', 1)"
    number = f"CASE WHEN {body} LIKE '#x%' THEN TRY_CAST('0' || {body}[2:] AS BIGINT) ELSE TRY_CAST(regexp_extract({body}, '^#([0-9]+)', 1) AS BIGINT) END"
    char = f"CASE WHEN {body} LIKE '#%' THEN chr(CAST(CASE WHEN {number} BETWEEN 1 AND 1114111 THEN {number} END AS INTEGER)) WHEN {body} <> '' THEN {_NAMES_SQL}[lower({body})] END"
    part = f"coalesce({char} || p[length({body}) + 2:], '&' || p)"
    return f"array_to_string(list_transform(string_split({value}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {part} END), '')"


def _plain_sql(value: str) -> str:
    """SQL of ``T.plain_text`` past the code."""
    out = _decoded_sql(f"regexp_replace({value}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({out}, '{_SPACE}', ' ', 'g'))"


def _stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, h)``: markup without code, as a column that is made once however often it is used."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_code(F.col("html")).alias("h"))


@query(f"WITH {_STRIP_SQL} SELECT page_id, CAST(length(h) AS BIGINT) AS n_chars, CAST(length({_plain_sql('h')}) AS BIGINT) AS n_text FROM stripped")
def stripped_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    return _stripped(spark, sf_dir).select("page_id", F.length(h).cast("long").alias("n_chars"), F.length(T.text_of(h)).cast("long").alias("n_text"))


@query(f"SELECT page_id, md5({_decoded_sql('html')}) AS decoded_md5 FROM pages")
def decoded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(T.decode_entities(F.col("html")).cast("binary")).alias("decoded_md5"))


@query(
    f"""WITH {_STRIP_SQL}
SELECT page_id, nullif({_plain_sql("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title', 1)")}, '') AS title,
  nullif({_plain_sql("regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1', 1)")}, '') AS first_h1,
  nullif(lower(regexp_extract(h, '(?is)<html[^>]*lang=.([a-zA-Z]+)', 1)), '') AS lang
FROM stripped"""
)
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = lambda tag: F.nullif(T.text_of(F.regexp_extract("h", rf"(?is)<{tag}[^>]*>(.*?)</{tag}", 1)), F.lit(""))
    lang = F.nullif(F.lower(F.regexp_extract("h", "(?is)<html[^>]*lang=.([a-zA-Z]+)", 1)), F.lit(""))
    return _stripped(spark, sf_dir).select("page_id", inner("title").alias("title"), inner("h1").alias("first_h1"), lang.alias("lang"))


@query(
    f"""WITH {_STRIP_SQL}
SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(h, '(?is)<nav\\b.*?</nav\\s*>'), '(?i)<a\\b')) AS BIGINT) AS nav_links,
  CAST(len(regexp_extract_all(regexp_extract(h, '(?is)<footer\\b.*?</footer\\s*>'), '(?i)<a\\b')) AS BIGINT) AS footer_links,
  CAST(len(regexp_extract_all(h, '(?i)<(?:input|select|textarea)\\b')) AS BIGINT) AS form_fields
FROM stripped"""
)
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("h")
    links = lambda tag: F.regexp_count(F.regexp_extract(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", 0), F.lit(r"(?i)<a\b")).cast("long")
    fields = F.regexp_count(html, F.lit(r"(?i)<(?:input|select|textarea)\b")).cast("long")
    return _stripped(spark, sf_dir).select("page_id", links("nav").alias("nav_links"), links("footer").alias("footer_links"), fields.alias("form_fields"))


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(substr(html, 1, 4000), '(?i)<html[\s>]|<!doctype\s+html') THEN 'html'
  WHEN regexp_matches(substr(html, 1, 4000), '(?m)^\s*#{1,3}\s+\S') THEN 'agent-markdown' ELSE 'not-html' END AS variant FROM pages"""
)
def body_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring("html", 1, 4000)
    variant = F.when(head.rlike(r"(?i)<html[\s>]|<!doctype\s+html"), "html").when(head.rlike(r"(?m)^\s*#{1,3}\s+\S"), "agent-markdown").otherwise("not-html")
    return table(spark, sf_dir, "pages").select("page_id", variant.alias("variant"))


_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TITLE = _plain_sql("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title', 1)")
_TITLE_SQL = f"WITH {_STRIP_SQL}, titles AS (SELECT page_id, nullif({_TITLE}, '') AS title FROM stripped)"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts(spark, sf_dir).select("page_id", "title")


@query(
    f"""{_TITLE_SQL}, votes AS (
  SELECT DISTINCT page_id, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '^[a-z]'))) AS word FROM titles
)
SELECT word, count(*) AS n FROM votes WHERE word NOT IN ({_STOP_SQL}) GROUP BY word ORDER BY n DESC, word LIMIT 12"""
)
def word_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioning.word_votes(_titles(spark, sf_dir), "title")


@query(f"{_TITLE_SQL} SELECT count(*) AS tracked, count(title) AS readable, count(*) - count(title) AS unreadable FROM titles")
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioning.coverage(_titles(spark, sf_dir), F.col("title"))


@query(
    r"""WITH hosts AS (
  SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages
)
SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS turn, min(page_id) OVER (PARTITION BY host) AS host_first FROM hosts"""
)
def host_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return series.interleaved(pages, "host", "page_id")


@query(
    """SELECT page_id, CASE WHEN http = 304 THEN 'unchanged' WHEN http IN (401, 403, 429, 451) THEN 'blocked' WHEN http >= 400 OR http < 200 OR http >= 300 THEN 'error'
  WHEN coalesce(length(html), 0) = 0 THEN 'error' WHEN page_id % 7 = 0 THEN 'unchanged' ELSE 'ok' END AS status
FROM (SELECT *, CASE page_id % 9 WHEN 0 THEN 304 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 301 WHEN 4 THEN 429 ELSE 200 END AS http FROM pages)"""
)
def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response codes are made up from page_id, as the table has none."""
    k = F.col("page_id") % 9
    http = F.when(k == 0, 304).when(k == 1, 403).when(k == 2, 500).when(k == 3, 301).when(k == 4, 429).otherwise(200)
    return table(spark, sf_dir, "pages").select("page_id", series.response_status(http, F.length("html"), F.col("page_id") % 7 == 0).alias("status"))


@query(
    """SELECT page_id, CASE status WHEN 'blocked' THEN CASE WHEN retry > 0 THEN greatest(retry, 3600)::DOUBLE ELSE least(86400 * pow(2.0, n), 2592000.0) END
  ELSE greatest(least(900 * pow(2.0, n), 86400.0), 60.0, delay) END AS seconds
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'blocked' ELSE 'error' END AS status, (page_id % 12)::DOUBLE AS n0, greatest(page_id % 12, 1) - 1 AS n,
  CASE WHEN page_id % 5 = 0 THEN page_id * 40 ELSE 0 END AS retry, (page_id % 4) * 1000.0 AS delay FROM pages)"""
)
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States are made up from page_id; the jitter of good reads is tested apart."""
    p = F.col("page_id")
    seconds = series.due_seconds(F.when(p % 2 == 0, "blocked").otherwise("error"), p % 12, F.when(p % 5 == 0, p * 40).otherwise(0), (p % 4) * 1000, p)
    return table(spark, sf_dir, "pages").select("page_id", seconds.alias("seconds"))


@query(
    r"""WITH paths AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*([^#]*)', 1), '^([^/]|$)', '/\1') AS path FROM pages
), rules(allow, pattern, re) AS (
  VALUES (false, '/', '^/'), (true, '/en/', '^/en/'), (false, '/en/1', '^/en/1'), (true, '/*.html$', '^/.*\.html$'), (false, '/fr/*?page=', '^/fr/.*\?page='), (true, '/de', '^/de'), (false, '/de', '^/de')
), hits AS (
  SELECT page_id, max(length(pattern)) FILTER (WHERE allow) AS a, max(length(pattern)) FILTER (WHERE NOT allow) AS d
  FROM paths JOIN rules ON regexp_matches(path, re) GROUP BY page_id
)
SELECT p.page_id, p.path, d IS NULL OR coalesce(a, -1) >= d AS allowed FROM paths p LEFT JOIN hits h ON p.page_id = h.page_id"""
)
def robots_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import robots

    rules = [(False, "/"), (True, "/en/"), (False, "/en/1"), (True, "/*.html$"), (False, "/fr/*?page="), (True, "/de"), (False, "/de")]
    path = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^#]*)", 1), "^([^/]|$)", "/$1")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.withColumn("allowed", robots.allowed(F.col("path"), rules))
