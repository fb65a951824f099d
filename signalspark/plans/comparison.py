"""Queries that compare rows with their group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison
from ..registry import query, table


@query("SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place, count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS ties FROM part")
def rank_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.ranked(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_size", "p_brand").drop("p_size")


@query(
    """WITH q AS (SELECT c_mktsegment, list_sort(list(c_acctbal)) AS v, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT c_mktsegment, v[1] AS least, v[least(n, floor(0.25 * n) + 1)::BIGINT] AS p25, v[least(n, floor(0.5 * n) + 1)::BIGINT] AS mid, v[least(n, floor(0.75 * n) + 1)::BIGINT] AS p75, v[n] AS greatest FROM q)
SELECT c_custkey, CASE WHEN least = greatest THEN 'flat' WHEN c_acctbal <= p25 THEN 'low' WHEN c_acctbal < mid THEN 'below' WHEN c_acctbal = mid THEN 'middle' WHEN c_acctbal <= p75 THEN 'above' ELSE 'high' END AS band
FROM customer JOIN s ON customer.c_mktsegment = s.c_mktsegment"""
)
def quartile_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    joined = rows.join(comparison.quartiles(rows, "c_acctbal", "c_mktsegment"), "c_mktsegment")
    return joined.select("c_custkey", comparison.placement(F.col("c_acctbal")).alias("band"))


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS run, count(*) AS targets, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view,
  count(*) FILTER (WHERE event_type = 'origin-shift') AS origin_shift FROM events GROUP BY 1"""
)
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run"), "event_type")
    return comparison.status_rollup(rows, ("click", "view", "origin-shift"), "event_type", "run")


@query(
    r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, greatest(60, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 100 END) AS gap FROM pages)
SELECT page_id, host, CAST(coalesce(sum(gap) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h"""
)
def request_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl delays are made up from page_id."""
    p = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return comparison.pacing(rows, "host", "page_id", F.when(p % 3 != 0, p % 100)).select("page_id", "host", "start")


@query(
    """SELECT event_id, CASE WHEN a <> b AND a <> 'unknown' AND b <> 'unknown' THEN 'different' WHEN ca IS NULL OR cb IS NULL THEN 'indeterminate' WHEN ca = cb THEN 'same' ELSE 'different' END AS moved,
  CASE WHEN seen IS NULL THEN NULL WHEN suspect > 0 THEN 'suspect' WHEN nulls > 0 THEN 'held' ELSE 'fresh' END AS status
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ci' WHEN 1 THEN 'local' ELSE 'unknown' END AS a, CASE event_id % 5 WHEN 0 THEN 'ci' ELSE 'unknown' END AS b, CASE WHEN event_id % 4 > 0 THEN 'C' || (event_id % 2) END AS ca,
  CASE WHEN event_id % 7 > 0 THEN 'C' || (event_id % 3) END AS cb, CASE WHEN event_id % 6 > 0 THEN value END AS seen, event_id % 2 AS suspect, event_id % 3 AS nulls FROM events)"""
)
def origin_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, suspicion and null counts are made up from event_id."""
    k = F.col("event_id")
    code = lambda n, m: F.when(k % n > 0, F.concat(F.lit("C"), (k % m).cast("string")))
    moved = comparison.origins_differ(F.when(k % 3 == 0, "ci").when(k % 3 == 1, "local").otherwise("unknown"), code(4, 2), F.when(k % 5 == 0, "ci").otherwise("unknown"), code(7, 3))
    status = comparison.signal_status(F.when(k % 6 > 0, F.col("value")), k % 2, k % 3)
    return table(spark, sf_dir, "events").select("event_id", moved.alias("moved"), status.alias("status"))
