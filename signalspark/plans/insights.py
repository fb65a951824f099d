"""Queries over companies' signals: documents as home pages, customers as companies, orders as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T
from ..operators import insights
from ..operators.comparison import signal_status
from ..registry import query, table
from .models import _WORDS, _values

# A document's first two lines are its headline and subhead where they are long enough to be read;
# labels say which are suspect and which are held from an earlier read.
SIGNALS_SQL = r"""signals AS (
  SELECT d.doc_id AS slug, d.source AS segment, d.source || '-' || d.doc_id AS name, nullif(regexp_extract(text, '^([^\n]{20,200})\n', 1), '') AS headline,
    nullif(regexp_extract(text, '^[^\n]*\n([^\n]{20,200})', 1), '') AS subhead, coalesce(toxic, 0) AS suspect, coalesce(1 - quality, 0) AS nulls
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
_STATUS_SQL = "CASE WHEN {c} IS NULL THEN NULL WHEN suspect > 0 THEN 'suspect' WHEN nulls > 0 THEN 'held' ELSE 'fresh' END"


def page_signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    line = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("slug"), F.col("source").alias("segment"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("name"),
        line(r"^([^\n]{20,200})\n").alias("headline"), line(r"^[^\n]*\n([^\n]{20,200})").alias("subhead"), F.coalesce("toxic", F.lit(0)).alias("suspect"), F.coalesce(1 - F.col("quality"), F.lit(0)).alias("nulls"),
    )


@query(
    f"""WITH {SIGNALS_SQL}, s AS (SELECT *, {_STATUS_SQL.format(c='headline')} AS status FROM signals)
SELECT segment, count(*) AS tracked, count(headline) AS readable, count(*) - count(headline) AS unreadable, count(*) FILTER (WHERE status = 'held') AS held, count(*) FILTER (WHERE status = 'suspect') AS suspect,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE headline IS NULL), '') AS missing FROM s GROUP BY segment"""
)
def coverage_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_signals_of(spark, sf_dir)
    found = insights.coverage(rows, F.col("headline"), F.col("suspect"), F.col("nulls"), F.col("name"), "segment")
    return found.withColumn("missing", F.array_join("missing", ","))


@query(
    f"""WITH {SIGNALS_SQL}, s AS (SELECT slug, {_STATUS_SQL.format(c='headline')} AS status FROM signals UNION ALL SELECT slug, {_STATUS_SQL.format(c='subhead')} FROM signals),
w AS (SELECT slug, max(CASE status WHEN 'suspect' THEN 3 WHEN 'held' THEN 2 WHEN 'fresh' THEN 1 END) AS k FROM s GROUP BY slug)
SELECT CASE k WHEN 3 THEN 'suspect' WHEN 2 THEN 'held' ELSE 'fresh' END AS status, count(*) AS n FROM w WHERE k IS NOT NULL GROUP BY k"""
)
def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_signals_of(spark, sf_dir)
    status = lambda c: signal_status(F.col(c), F.col("suspect"), F.col("nulls"))
    each = rows.select("slug", F.explode(F.array(status("headline"), status("subhead"))).alias("status"))
    return insights.tally(each, "slug", F.col("status"))


_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    f"""WITH {SIGNALS_SQL}, votes AS (SELECT DISTINCT slug, unnest(list_filter({_WORDS.format(t='headline')}, lambda w: length(w) >= 3)) AS word FROM signals),
n AS (SELECT word, count(*) AS n FROM votes WHERE word NOT IN ({_STOP_SQL}) GROUP BY word)
SELECT word, n, (SELECT count(*) FROM n) AS distinct_words FROM n ORDER BY n DESC, word LIMIT 12"""
)
def headline_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.headline_words(page_signals_of(spark, sf_dir), "headline")


# Labels of three fields, with words of machine intelligence in some: the tables' texts have none.
_FIELDS = ["headline", "subhead", "label"]
_FIELDS_SQL = """fields AS (SELECT c_custkey AS slug, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'The agentic ' || lower(c_mktsegment) ELSE c_mktsegment END AS headline,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Copilots and AI for all' WHEN 2 THEN 'An autonomous agent' ELSE c_name END AS subhead, CASE WHEN c_custkey % 3 > 0 THEN 'tool' END AS label FROM customer)"""
_TERMS_SQL = f"terms(form, family) AS (VALUES {_values((f, n) for n, fs in T.AI_TERMS.items() for f in fs)})"
_HITS_SQL = ", ".join(f"coalesce(len(list_intersect({_WORDS.format(t=c)}, (SELECT list(form) FROM terms))) > 0, false) AS {c}_hit" for c in _FIELDS)
_SAID_SQL = f"WITH {_FIELDS_SQL}, {_TERMS_SQL}, said AS (SELECT *, {_HITS_SQL} FROM fields), answers AS (SELECT *, CASE WHEN coalesce(headline, subhead, label) IS NOT NULL THEN headline_hit OR subhead_hit OR label_hit END AS ai FROM said)"


def fields_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    headline = F.when(k % 4 == 1, F.concat(F.lit("The agentic "), F.lower("c_mktsegment"))).when(k % 4 > 1, F.col("c_mktsegment"))
    subhead = F.when(k % 6 == 1, "Copilots and AI for all").when(k % 6 == 2, "An autonomous agent").when(k % 6 > 2, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(k.alias("slug"), F.col("c_name").alias("name"), headline.alias("headline"), subhead.alias("subhead"), F.when(k % 3 > 0, F.lit("tool")).alias("label"))


@query(f"{_SAID_SQL} SELECT count(*) FILTER (WHERE ai) AS mention, count(*) FILTER (WHERE NOT ai) AS quiet, count(*) FILTER (WHERE ai IS NULL) AS unreadable FROM answers")
def ai_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.ai_answers(fields_of(spark, sf_dir), _FIELDS)


@query(f"{_SAID_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c}_hit) AS mention, count({c}) AS readable FROM said" for c in _FIELDS))
def ai_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.ai_by_field(fields_of(spark, sf_dir), _FIELDS)


@query(
    f"""WITH {_FIELDS_SQL}, {_TERMS_SQL}, each AS ({' UNION ALL '.join(f"SELECT slug, unnest({_WORDS.format(t=c)}) AS w FROM fields" for c in _FIELDS)}),
n AS (SELECT family, count(DISTINCT slug) AS n FROM each JOIN terms ON form = w GROUP BY family)
SELECT f.family, coalesce(n, 0) AS n FROM (SELECT DISTINCT family FROM terms) f LEFT JOIN n ON f.family = n.family"""
)
def ai_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.ai_by_term(fields_of(spark, sf_dir), _FIELDS)


@query(f"{_SAID_SQL} SELECT name, ai AS mentions FROM answers WHERE ai IS NOT NULL")
def ai_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.ai_grid(fields_of(spark, sf_dir), _FIELDS, "name")


# A customer's orders are its plans: pending ones have no price, and low priority marks a free plan.
_PLANS_SQL = """plans AS (SELECT c_custkey AS slug, c_name AS name, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 2000) END AS amount, left(o_orderpriority, 1) AS currency, o_orderpriority
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey), company AS (
  SELECT slug, any_value(name) AS name, count(o_orderkey) > 0 AS listed, CASE WHEN count(o_orderkey) > 0 THEN coalesce(bool_or(o_orderpriority = '5-LOW'), false) END AS free,
    min(amount) FILTER (WHERE amount > 0) AS entry, count(*) FILTER (WHERE o_orderkey IS NOT NULL AND amount IS NULL) > 0 AS sales FROM plans GROUP BY slug
)"""


def plans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    tier = F.struct(F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 2000).cast("double")).alias("amount"), F.substring("o_orderpriority", 1, 1).alias("currency"))
    lists = orders.groupBy(F.col("o_custkey").alias("slug")).agg(F.collect_list(tier).alias("tiers"), F.max(F.col("o_orderpriority") == "5-LOW").alias("free"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name")).join(lists, "slug", "left")


@query(
    f"""WITH {_PLANS_SQL} SELECT count(*) FILTER (WHERE free) AS free_yes, count(*) FILTER (WHERE NOT free) AS free_no, count(*) FILTER (WHERE free IS NULL) AS free_unreadable,
  count(*) FILTER (WHERE listed) AS tiers_readable, count(*) FILTER (WHERE sales) AS contact_sales, quantile_disc(entry, 0.5) AS median_entry FROM company"""
)
def pricing_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.pricing_shape(plans_of(spark, sf_dir), "tiers", "free")


@query(
    "WITH " + _PLANS_SQL + ", dim(bucket, low, high) AS (VALUES " + ", ".join(f"('{k}', {a}, {'1e300' if b is None else b})" for k, a, b in M.PRICE_BUCKETS)
    + ") SELECT bucket, count(slug) AS n FROM dim LEFT JOIN company ON entry >= low AND entry < high GROUP BY bucket"
)
def entry_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.entry_buckets(plans_of(spark, sf_dir), "tiers")


@query(f"WITH {_PLANS_SQL} SELECT currency, count(DISTINCT slug) AS n FROM plans WHERE currency IS NOT NULL GROUP BY currency")
def currency_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.currency_mix(plans_of(spark, sf_dir), "tiers")


@query(f"WITH {_PLANS_SQL} SELECT name FROM company WHERE sales")
def contact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.contact_sales(plans_of(spark, sf_dir), "tiers", "name")


@query("SELECT lower(p_type || ' ' || split_part(p_name, ' ', 1)) AS label, count(*) AS n FROM part WHERE p_size % 5 > 0 GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("p_size") % 5 > 0, F.concat("p_type", F.lit(" "), F.split("p_name", " ")[0]))
    return insights.category_distribution(table(spark, sf_dir, "part").select(label.alias("label")), "label")


@query(
    """WITH g AS (SELECT p_brand AS noun, count(*) AS n FROM part GROUP BY p_brand), k AS (SELECT n FROM g ORDER BY n DESC, noun LIMIT 5)
SELECT (SELECT sum(n) FROM g)::BIGINT AS readable, (SELECT sum(n) FROM k)::BIGINT AS kept, ((SELECT sum(n) FROM g) - (SELECT sum(n) FROM k))::BIGINT AS tail"""
)
def noun_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.noun_tail(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("noun")).agg(F.count("*").alias("n")), "readable", 5)
