"""Queries on robots.txt of many hosts. The tables hold none, so each customer is a host whose file is
written from its segment, its nation and its balance; orders are addresses on these hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import robots
from ..registry import query, table

_BODY = r"""concat_ws('\n', concat('# of ', c_name), 'User-agent: other', if(c_nationkey % 3 = 0, 'User-Agent: Signalbot', 'user-agent: signal'), 'Disallow: /', concat('Allow: /', lower(c_mktsegment), '  # its segment'),
  concat('Crawl-delay: ', c_nationkey, ',5'), if(c_nationkey % 4 = 1, 'Content-Signal: search=no, ai-train=no', 'Content-Signal: search=yes'), 'User-agent: *', concat('Disallow: /', c_nationkey % 5), concat('Allow: /*/o', c_nationkey % 10, '*$'), 'Disallow:', 'User-agent: signalbot', 'Allow: /*-', concat('Disallow: /', c_nationkey % 5, '-*?k=', c_nationkey % 3))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".example")).alias("host"), F.expr(_BODY).alias("body"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://h/"), F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("%2f")), F.lit("/o"), (F.col("o_orderkey") % 100).cast("string"), F.lit("?k="), (F.col("o_orderkey") % 3).cast("string"), F.lit("#top"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(".example")).alias("host"), robots.normal_path(url).alias("path"))


_HOST = "c_custkey || '.example'"


@query(
    f"""SELECT {_HOST} AS host, unnest([1, 2]) AS "group", unnest(['other,' || CASE WHEN c_nationkey % 3 = 0 THEN 'signalbot' ELSE 'signal' END, '*']) AS agents,
  unnest(['disallow=/ allow=/' || lower(c_mktsegment) || ' crawl-delay=' || c_nationkey || ',5 content-signal=' || CASE WHEN c_nationkey % 4 = 1 THEN 'search=no, ai-train=no' ELSE 'search=yes' END, 'disallow=/' || c_nationkey % 5 || ' allow=/*/o' || c_nationkey % 10 || '*$ disallow=']) AS said FROM customer
UNION ALL SELECT {_HOST}, 3, 'signalbot', 'allow=/*- disallow=/' || c_nationkey % 5 || '-*?k=' || c_nationkey % 3 FROM customer"""
)
def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of every file: its agents, and its lines in their order."""
    lines = robots.lines(_files(spark, sf_dir))
    joined = lambda c: F.array_sort(F.collect_list(c))
    names = F.transform(joined(F.when(F.col("name") == "user-agent", F.struct("line", F.lower("value").alias("v")))), lambda x: x["v"])
    said = F.transform(joined(F.when(F.col("name") != "user-agent", F.struct("line", F.concat("name", F.lit("="), "value").alias("v")))), lambda x: x["v"])
    return lines.groupBy("host", "group").agg(F.concat_ws(",", names).alias("agents"), F.concat_ws(" ", said).alias("said")).withColumn("group", F.col("group").cast("int"))


_MINE = "c_nationkey % 3 = 0"


@query(
    f"""SELECT {_HOST} AS host, 'signalbot' AS matched, CASE WHEN {_MINE} THEN c_nationkey + 0.5 END AS crawl_delay, CASE WHEN {_MINE} THEN c_nationkey % 4 <> 1 END AS search FROM customer"""
)
def robots_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay and word on searching of the groups that hold for one crawler, which has one to three of them."""
    found = robots.policies(robots.lines(_files(spark, sf_dir)), "Signalbot")
    return found.select("host", "matched", "crawl_delay", F.expr("signals['search']").alias("search"))


@query(
    f"""WITH u AS (SELECT o_orderkey, o_custkey || '.example' AS host, '/' || replace(replace(lower(o_orderpriority), ' ', '%2f'), '%2f', '%2F') || '/o' || o_orderkey % 100 || '?k=' || o_orderkey % 3 AS path FROM orders),
r AS (SELECT {_HOST} AS host, false AS allow, '/' AS p, '^/' AS x FROM customer WHERE {_MINE} UNION ALL SELECT {_HOST}, true, '/' || lower(c_mktsegment), '^/' || lower(c_mktsegment) FROM customer WHERE {_MINE}
  UNION ALL SELECT {_HOST}, true, '/*-', '^/.*-' FROM customer UNION ALL SELECT {_HOST}, false, '/' || c_nationkey % 5 || '-*?k=' || c_nationkey % 3, '^/' || c_nationkey % 5 || '-.*\\?k=' || c_nationkey % 3 FROM customer),
b AS (SELECT o_orderkey, max(struct_pack(n := length(p), allow := allow, p := p)) AS best FROM u JOIN r USING (host) WHERE regexp_matches(path, x) GROUP BY 1)
SELECT o_orderkey, u.host, path, CASE WHEN {_MINE} AND c_nationkey % 4 = 1 THEN false ELSE coalesce(best.allow, true) END AS allowed, CASE WHEN {_MINE} AND c_nationkey % 4 = 1 THEN 'Content-Signal: search=no' ELSE best.p END AS rule
FROM u LEFT JOIN b USING (o_orderkey) LEFT JOIN customer ON u.host = {_HOST}"""
)
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each address may be fetched, and the rule that says so, on as many hosts as there are customers."""
    lines = robots.lines(_files(spark, sf_dir))
    return robots.decisions(_urls(spark, sf_dir), robots.rules_for(lines, "signalbot"), robots.policies(lines, "signalbot"))
